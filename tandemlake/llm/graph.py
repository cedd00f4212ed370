"""Connected components, as the library has them."""

from ..operators.classes import components  # noqa: F401
