"""Signature rules of the license scan, most specific group first.

Each line is `label | keyword | regex`. Rules run on the text's words in lower case with single blanks between them
("apache license version 2 0"), and only where the keyword occurs. A group's number is the priority of its rules.
"""

from __future__ import annotations

#: License notices and grants in full wording.
NOTICES = r"""
apache-2.0 | apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | apache | apache org licenses license 2 0(?: html| txt)?
apache-2.0 | apache | opensource org licenses apache 2 0
apache-1.1 | apache | apache software license version 1 1
apache-1.0 | apache | apache software license version 1 0
gpl-3.0-or-later | general public license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | general public license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-only | general public license | gnu general public license version 3 as published by the free software foundation
gpl-2.0-only | general public license | gnu general public license version 2 as published by the free software foundation
lgpl-3.0-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | lesser general public | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.0-or-later | library general public | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
agpl-3.0-or-later | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0 | gnu org | gnu org licenses gpl 3 0(?: html| txt)?
gpl-2.0 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
lgpl-3.0 | gnu org | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-2.1 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
agpl-3.0 | gnu org | gnu org licenses agpl 3 0(?: html| txt)?
gfdl-1.3 | gnu org | gnu org licenses fdl 1 3(?: html| txt)?
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | without warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | no attribution | mit (?:license )?no attribution(?: license)?
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | endorse or promote | neither the name of (?:\S+ ){1,12}may be used to endorse or promote products
bsd-2-clause | binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
isc | permission to use | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is
mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla org | mozilla org mpl 2 0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | mozilla public | the contents of this file are subject to the mozilla public license version 1 0
epl-2.0 | eclipse | made available under the terms of the eclipse public license(?: v)? 2 0
epl-1.0 | eclipse | made available under the terms of the eclipse public license(?: v)? 1 0
epl-2.0 | eclipse org | eclipse org legal epl 2 0
epl-1.0 | eclipse org | eclipse org legal epl v10(?: html)?
cddl-1.0 | common development | subject to the terms of the common development and distribution license(?: version)? 1 0
cddl-1.1 | common development | subject to the terms of the common development and distribution license(?: version)? 1 1
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | unlicense org | unlicense org
wtfpl | do what the fuck | do what the fuck you want to public license(?: version 2)?
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software | the origin of this software must not be misrepresented
bsl-1.0 | boost | distributed under the boost software license version 1 0
bsl-1.0 | boost org | boost org license 1 0 txt
cc0-1.0 | waived all copyright | to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighboring rights
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | publicdomain | creativecommons org publicdomain mark 1 0
postgresql | without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
artistic-2.0 | artistic | licensed under the artistic license(?: version)? 2 0
artistic-1.0 | artistic | licensed under the artistic license(?: version)? 1 0
perl | perl | under the same terms as perl itself
eupl-1.2 | eupl | licensed under the eupl(?: version)? 1 2
eupl-1.1 | eupl | licensed under the eupl(?: version)? 1 1
ms-pl | microsoft | microsoft public license ms pl
ms-rl | microsoft | microsoft reciprocal license ms rl
openssl | openssl | this product includes software developed by the openssl project
json | good not evil | the software shall be used for good not evil
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
ofl-1.1 | open font | licensed under the sil open font license version 1 1
odbl-1.0 | open database | made available under the open database license
odc-by-1.0 | data commons | open data commons attribution license(?: v)? 1 0
pddl-1.0 | data commons | open data commons public domain dedication (?:and )?license
proprietary | all rights reserved | copyright (?:c )?(?:\S+ ){1,10}all rights reserved
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
"""

#: Creative Commons licences with their terms, versions and addresses.
CREATIVE = r"""
cc-by-nc-nd-4.0 | cc by | cc by nc nd 4 0
cc-by-nc-sa-4.0 | cc by | cc by nc sa 4 0
cc-by-nc-4.0 | cc by | cc by nc 4 0
cc-by-nd-4.0 | cc by | cc by nd 4 0
cc-by-sa-4.0 | cc by | cc by sa 4 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-nc-nd-3.0 | cc by | cc by nc nd 3 0
cc-by-nc-sa-3.0 | cc by | cc by nc sa 3 0
cc-by-nc-3.0 | cc by | cc by nc 3 0
cc-by-nd-3.0 | cc by | cc by nd 3 0
cc-by-sa-3.0 | cc by | cc by sa 3 0
cc-by-3.0 | cc by | cc by 3 0
cc-by-nc-nd-2.5 | cc by | cc by nc nd 2 5
cc-by-nc-sa-2.5 | cc by | cc by nc sa 2 5
cc-by-sa-2.5 | cc by | cc by sa 2 5
cc-by-2.5 | cc by | cc by 2 5
cc-by-nc-sa-2.0 | cc by | cc by nc sa 2 0
cc-by-sa-2.0 | cc by | cc by sa 2 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-3.0 | creative commons | creative commons attribution non ?commercial share ?alike 3 0(?: unported)?(?: license)?
cc-by-nc-3.0 | creative commons | creative commons attribution non ?commercial 3 0(?: unported)?(?: license)?
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-2.5 | creative commons | creative commons attribution share ?alike 2 5
cc-by-2.5 | creative commons | creative commons attribution 2 5
cc-by-sa-2.0 | creative commons | creative commons attribution share ?alike 2 0
cc-by-2.0 | creative commons | creative commons attribution 2 0
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | creativecommons | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | creativecommons | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa | creativecommons | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by | creativecommons | creativecommons org licenses by(?: [1-4] [05])?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
"""

#: Machine-readable tags.
TAGS = r"""
apache-2.0 | spdx | spdx license identifier apache 2 0
apache-1.1 | spdx | spdx license identifier apache 1 1
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
mpl-2.0 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
epl-2.0 | spdx | spdx license identifier epl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
bsl-1.0 | spdx | spdx license identifier bsl 1 0
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
postgresql | spdx | spdx license identifier postgresql
artistic-2.0 | spdx | spdx license identifier artistic 2 0
eupl-1.2 | spdx | spdx license identifier eupl 1 2
ms-pl | spdx | spdx license identifier ms pl
ofl-1.1 | spdx | spdx license identifier ofl 1 1
python-2.0 | spdx | spdx license identifier python 2 0
ncsa | spdx | spdx license identifier ncsa
upl-1.0 | spdx | spdx license identifier upl 1 0
"""

#: Titles with a version.
TITLES = r"""
apache-2.0 | apache license | apache license(?: version| v)? 2(?: 0)?
apache-1.1 | apache license | apache license(?: version| v)? 1 1
gpl-3.0 | general public license | gnu general public license(?: version| v)? ?3(?: 0)?(?: or (?:any )?later)?
gpl-2.0 | general public license | gnu general public license(?: version| v)? ?2(?: 0)?(?: or (?:any )?later)?
gpl-1.0 | general public license | gnu general public license(?: version| v)? ?1(?: 0)?
lgpl-3.0 | lesser general public | gnu lesser general public license(?: version| v)? ?3(?: 0)?
lgpl-2.1 | lesser general public | gnu lesser general public license(?: version| v)? ?2 1
lgpl-2.0 | library general public | gnu library general public license(?: version| v)? ?2(?: 0)?
agpl-3.0 | affero | gnu affero general public license(?: version| v)? ?3(?: 0)?
gfdl-1.3 | documentation license | gnu free documentation license(?: version| v)? ?1 3
gfdl-1.2 | documentation license | gnu free documentation license(?: version| v)? ?1 2
gfdl-1.1 | documentation license | gnu free documentation license(?: version| v)? ?1 1
mpl-2.0 | mozilla public | mozilla public license(?: version| v)? ?2 0
mpl-1.1 | mozilla public | mozilla public license(?: version| v)? ?1 1
epl-2.0 | eclipse public | eclipse public license(?: version| v)? ?2 0
epl-1.0 | eclipse public | eclipse public license(?: version| v)? ?1 0
cpl-1.0 | common public | common public license(?: version| v)? ?1 0
cddl-1.0 | common development | common development and distribution license(?: version| v)? ?1 0
cddl-1.1 | common development | common development and distribution license(?: version| v)? ?1 1
bsl-1.0 | boost software | boost software license(?: version| v)? ?1 0
artistic-2.0 | artistic license | artistic license(?: version| v)? ?2 0
artistic-1.0 | artistic license | artistic license(?: version| v)? ?1 0
eupl-1.2 | european union public | european union public licen[cs]e(?: version| v)? ?1 2
eupl-1.1 | european union public | european union public licen[cs]e(?: version| v)? ?1 1
ofl-1.1 | open font | (?:sil )?open font license(?: version| v)? ?1 1
osl-3.0 | open software license | open software license(?: version| v)? ?3 0
afl-3.0 | academic free | academic free license(?: version| v)? ?3 0
cecill-2.1 | cecill | cecill(?: version| v)? ?2 1
cecill-2.0 | cecill | cecill(?: version| v)? ?2(?: 0)?
lppl-1.3c | latex project | latex project public license(?: version| v)? ?1 3c?
upl-1.0 | universal permissive | universal permissive license(?: version| v)? ?1 0
busl-1.1 | business source | business source license(?: version| v)? ?1 1
sspl-1.0 | server side public | server side public license(?: version| v)? ?1(?: 0)?
bsd-2-clause | 2 clause | bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause | 2 clause | 2 clause bsd(?: license)?
bsd-3-clause | 3 clause | bsd 3 clause(?: new)?(?: license)?
bsd-3-clause | 3 clause | 3 clause bsd(?: license)?
bsd-4-clause | 4 clause | (?:bsd 4 clause|4 clause bsd)(?: license)?
"""

#: Names without a version, short names and hints.
NAMES = r"""
agpl | affero | (?:gnu )?affero general public license
lgpl | lesser general public | (?:gnu )?lesser general public license
lgpl | library general public | (?:gnu )?library general public license
gpl | general public license | gnu general public license
gfdl | documentation license | gnu free documentation license
gpl-3.0 | gpl | gplv?3
gpl-2.0 | gpl | gplv?2
lgpl-3.0 | lgpl | lgplv?3
lgpl-2.1 | lgpl | lgplv?2 1
agpl-3.0 | agpl | agplv?3
apache | apache license | (?:the )?apache license
apache | apache software license | apache software license
mit | mit license | (?:the )?mit license
mit | expat license | (?:the )?expat license
mit | mit licensed | mit licensed
bsd-new | bsd license | (?:new|modified|revised) bsd license
bsd-simplified | bsd license | (?:simplified|freebsd) bsd license
bsd | bsd license | (?:the )?bsd license
isc | isc license | (?:the )?isc license
zlib | zlib | (?:the )?zlib(?: libpng)? license
mpl | mozilla public | mozilla public license
epl | eclipse public | eclipse public license
cddl | common development | common development and distribution license
bsl-1.0 | boost software | boost software license
artistic | artistic license | (?:the )?artistic license
unlicense | unlicense | (?:the )?unlicense
eupl | european union public | european union public licen[cs]e
ofl | open font | (?:sil )?open font license
odbl | open database | open database license
python-2.0 | python software foundation | python software foundation license
php-3.01 | php license | (?:the )?php license
ruby | ruby license | (?:the )?ruby license
vim | vim license | (?:the )?vim license
w3c | w3c software | w3c software (?:notice and )?license
ncsa | illinois | university of illinois (?:ncsa )?open source license
postgresql | postgresql license | (?:the )?postgresql license
openssl | openssl license | (?:the )?openssl license
beerware | beerware | (?:the )?beerware license
sspl | server side public | server side public license
busl | business source | business source license
elastic-2.0 | elastic license | elastic license(?: 2 0| v2)?
llama | llama | llama ?[23]? community license(?: agreement)?
openrail | rail | (?:creativeml )?open ?rail(?: [ms])?(?: license)?
rail | responsible ai | (?:bigscience )?responsible ai license
cc-by-nc-nd | cc by | cc by nc nd
cc-by-nc-sa | cc by | cc by nc sa
cc-by-nc | cc by | cc by nc
cc-by-nd | cc by | cc by nd
cc-by-sa | cc by | cc by sa
cc-by | cc by | cc by
cc-by | creative commons | creative commons attribution(?: license)?
cc | creative commons | (?:a )?creative commons license
public-domain | public domain | (?:released (?:in|into|to)|dedicated to|placed in) the public domain
all-rights-reserved | all rights reserved | all rights reserved
copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
permissive-hint | permission | permission is (?:hereby )?granted
licensed-under | licensed under | licensed under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+)? licen[cs]e
licensed-under | released under | released under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+)? licen[cs]e
licensed-under | distributed under | distributed under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+)? licen[cs]e
licensed-under | available under | available under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+)? licen[cs]e
licensed-under | published under | published under (?:the )?(?:terms of )?(?:the )?\S+(?: \S+)? licen[cs]e
"""

GROUPS = (NOTICES, CREATIVE, TAGS, TITLES, NAMES)
