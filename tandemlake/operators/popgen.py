"""Linkage disequilibrium, FST, PCA and neighbour joining."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import cut, discard
from .ordering import numbered

#: Rows of a distance matrix that a driver kernel takes.
DENSE_LIMIT = 5_000
#: Distinct genotypes of two sets that meet in a task.
GENOTYPES_LIMIT = 1_000_000
#: Samples of a set that a task of linkage's P values shuffles at a time.
PART_ROWS = 1_000_000
#: Combinations of values whose counts linkage's P values draw instead of shuffling samples.
TABLE_CELLS = 2_000


def _long(wide: DataFrame, markers: list[int], keys) -> DataFrame:
    """keys, locus, v of complete genotypes."""
    kept = wide.dropna(subset=[f"m{m}" for m in markers])
    return kept.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("locus"), F.col(f"m{m}").alias("v")) for m in markers])))


def linkage(wide: DataFrame, markers: list[int], keys=("set_id",), weight: str | None = None) -> DataFrame:
    """keys, n, ia: the standardised index of association, from one- and two-locus counts without pairs of samples.

    weight: a column that says how many samples a row stands for. Sets of at most two complete samples have none (null).
    """
    kept = wide.dropna(subset=[f"m{m}" for m in markers])
    both = [F.struct(F.lit(a).alias("k"), F.lit(b).alias("l"), F.col(f"m{a}").alias("v"), F.col(f"m{b}").alias("w")) for i, a in enumerate(markers) for b in markers[: i + 1]]
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    met = kept.select(*keys, times.alias("_times"), F.inline(F.array(*both))).groupBy(*keys, "k", "l", "v", "w").agg(F.sum("_times").alias("c"))
    c = F.col("c").cast("double")
    # m is the pairs of samples equal at both loci; k = l gives those equal at one.
    per = met.groupBy(*keys, "k", "l").agg(F.sum(c * (c - 1) / 2).alias("m"), F.sum("c").alias("n"), F.sum(c * c).alias("squares"))
    gathered = per.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(F.struct("k", "l", "m", "squares")).alias("x"))  # pairs of loci in a row
    n = F.col("n").cast("double")
    p = n * (n - 1) / 2
    ones = F.filter("x", lambda e: e["k"] == e["l"])
    gathered = gathered.withColumn("p", p).withColumn("one", ones).withColumn("same", F.map_from_entries(F.transform(ones, lambda e: F.struct(e["k"], e["m"]))))
    same = lambda locus: F.element_at(F.col("same"), locus)
    add = lambda column, term: F.aggregate(column, F.lit(0.0), lambda acc, e: acc + term(e))
    # Pairs that differ at both loci; two different loci stand for both orders.
    dd = add("x", lambda e: F.when(e["k"] == e["l"], F.col("p") - e["m"]).otherwise(2 * (F.col("p") - same(e["k"]) - same(e["l"]) + e["m"])))
    h = lambda e: F.coalesce(F.try_divide(n * (1 - e["squares"] / (n * n)), n - 1), F.lit(0.0))
    d, ve = add("one", lambda e: F.col("p") - e["m"]), add("one", lambda e: h(e) * (1 - h(e)))
    vd = F.try_divide(dd, "p") - F.pow(F.try_divide(d, "p"), F.lit(2.0))
    ia = F.try_divide(F.try_divide(vd, ve) - 1.0, F.lit(float(len(markers) - 1)))
    return gathered.select(*keys, "n", F.when(F.col("n") > 2, ia).alias("ia"))


def _agreements(columns: list[np.ndarray], width: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the pair of loci, cells, counts): how often two values meet, for each pair of loci."""
    pair = 0
    for i in range(len(columns)):
        for j in range(i):
            mixed = columns[i].astype(np.int64) * width[j] + columns[j]
            if width[i] * width[j] > 4 * len(mixed) + 1024:
                cells, counts = np.unique(mixed, return_counts=True)
            else:
                every = np.bincount(mixed)
                cells = np.flatnonzero(every)
                counts = every[cells]
            yield pair, cells, counts
            pair += 1


def _tables(every: list[np.ndarray], times: int, rng: np.random.Generator) -> np.ndarray:
    """How many samples have each combination of values (an axis a locus) in each of `times` shuffles of all loci.

    The combinations of the loci so far are filled one after the other from what is left of the next locus' values, one
    value after the other: each is a hypergeometric draw, for all shuffles at once.
    """
    found = np.tile(every[0], (times, 1))
    for counts in every[1:]:
        left, more = np.tile(counts, (times, 1)), np.zeros((*found.shape, len(counts)), np.int64)
        for i in range(found.shape[1]):
            need, rest = found[:, i].copy(), left.sum(axis=1)
            for k in range(len(counts)):
                rest -= left[:, k]
                more[:, i, k] = rng.hypergeometric(left[:, k], rest, need)
                need -= more[:, i, k]
            left -= more[:, i]
        found = more.reshape(times, -1)
    return found.reshape(times, *[len(c) for c in every])


def _agreeing(table: np.ndarray) -> np.ndarray:
    """The pairs of samples that agree at two loci, summed over the pairs of loci, of each table."""
    loci = range(1, table.ndim)
    twos = [table.sum(axis=tuple(k for k in loci if k not in (i, j))) for i in loci for j in range(1, i)]
    return sum((c * (c - 1) // 2).sum(axis=(1, 2)) for c in twos)


def linkage_pvalue(wide: DataFrame, markers: list[int], rounds: int = 10_000, seed: int = 1, part_rows: int = PART_ROWS) -> DataFrame:
    """set_id, n, p: (1 + shuffles with at least the observed linkage) / (1 + rounds), each locus shuffled on its own.

    With the loci's counts given, the variance of mismatches grows with the pairs of samples that agree at two loci, so
    these are compared, as whole numbers. A shuffle needs only how often each value occurs. Blocks of rounds are dealt to
    tasks. Where the loci have at most TABLE_CELLS combinations of values, and fewer than the set has samples, how many
    samples get each is drawn, whatever their number. Else the samples are shuffled, and a set of more than `part_rows` samples is dealt in parts: how many of each value a part gets is drawn
    without replacement, from a seed of the round that all its parts know, and each part shuffles its own share; what
    meets in the parts is summed. So a task's memory follows part_rows, whatever the set. Sets have below 10^9 samples.
    """
    ship(wide.sparkSession)
    block = 250
    loci = _long(wide, markers, ("set_id", "sample_id"))
    counts = loci.groupBy("set_id", "locus", "v").agg(F.count("*").alias("c"))
    per_set = counts.groupBy("set_id").agg(F.collect_list(F.struct("locus", "v", "c")).alias("counts"), (F.sum("c") / len(markers)).cast("bigint").alias("n"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    kept = wide.dropna(subset=[f"m{m}" for m in markers])
    both = [(a, b) for i, a in enumerate(markers) for b in markers[:i]]
    tables = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m{a}").alias("v"), F.col(f"m{b}").alias("w")) for i, (a, b) in enumerate(both)])
    met = kept.select("set_id", F.inline(tables)).groupBy("set_id", "i", "v", "w").agg(F.count("*").alias("c"))
    observed = met.groupBy("set_id").agg(F.sum(pairs("c")).cast("bigint").alias("observed"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(block)), lambda b: F.struct(b.alias("block"), F.least(F.lit(block), F.lit(rounds) - b).alias("rounds")))
    work = per_set.withColumn("task", F.explode(sizes)).select("set_id", "n", "counts", "task.*")
    cells = F.lit(1.0)
    for m in markers:
        cells = cells * F.size(F.filter("counts", lambda e, m=m: e["locus"] == m))
    work = work.withColumn("table", (cells <= TABLE_CELLS) & (cells < F.col("n")))
    drawn_parts = F.when(F.col("table"), F.lit(0)).otherwise(F.greatest(F.ceil(F.col("n") / part_rows) - 1, F.lit(0)).cast("int"))
    work = work.withColumn("part", F.explode(F.sequence(F.lit(0), drawn_parts)))

    def shuffle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, n, rows, first, times, part, table in zip(f["set_id"], f["n"], f["counts"], f["block"], f["rounds"], f["part"], f["table"]):
                code = zlib.crc32(str(name).encode())
                every = [np.array([c for _, c in sorted((r["v"], r["c"]) for r in rows if r["locus"] == m)], np.int64) for m in markers]
                width = [len(c) for c in every]
                if table:
                    agree = _agreeing(_tables(every, int(times), np.random.default_rng([seed, first, code])))
                    yield pd.DataFrame({"set_id": name, "n": n, "round": np.arange(first, first + times), "pair": -1, "cell": 0, "c": agree})
                    continue
                for r in range(first, first + times):
                    deal, own = np.random.default_rng([seed, r, code]), np.random.default_rng([seed, r, code, part + 1])
                    shares = []
                    for c in every:
                        # The shares of the parts before this one are drawn first, so all parts agree on them.
                        for at in range(part + 1):
                            size = min(part_rows, int(n) - at * part_rows)
                            share = c if size == c.sum() else deal.multivariate_hypergeometric(c, size, method="marginals")
                            c = c - share
                        # Parts after this one draw nothing here: each locus has its own stream.
                        deal = deal.spawn(1)[0]
                        shares.append(share)
                    columns = [own.permutation(np.repeat(np.arange(len(c), dtype=np.uint16 if len(c) < 65_536 else np.uint32), c)) for c in shares]
                    found = list(_agreements(columns, width))
                    if n <= part_rows:
                        agree = sum(int((c * (c - 1) // 2).sum()) for _, _, c in found)
                        yield pd.DataFrame({"set_id": [name], "n": [n], "round": [r], "pair": [-1], "cell": [0], "c": [agree]})
                    else:
                        pair, cell, c = (np.concatenate(x) for x in zip(*((np.full(len(x), i), x, y) for i, x, y in found)))
                        yield pd.DataFrame({"set_id": name, "n": n, "round": r, "pair": pair, "cell": cell, "c": c})

    kind = wide.schema["set_id"].dataType.simpleString()
    tasks = 4 * wide.sparkSession.sparkContext.defaultParallelism  # short rows of much work: by their sizes they would be one task
    drawn = work.repartition(tasks, "set_id", "block", "part").mapInPandas(shuffle, f"set_id {kind}, n bigint, round bigint, pair int, cell bigint, c bigint")
    merged = drawn.groupBy("set_id", "n", "round", "pair", "cell").agg(F.sum("c").alias("c"))
    agreed = merged.groupBy("set_id", "n", "round").agg(F.sum(F.when(F.col("pair") < 0, F.col("c")).otherwise(F.expr("c * (c - 1) div 2"))).alias("agree"))
    return agreed.join(observed, "set_id").groupBy("set_id").agg(F.first("n").alias("n"), ((1 + F.count_if(F.col("agree") >= F.col("observed"))) / (1 + F.count("*"))).alias("p"))


def fst_both(wide: DataFrame, markers: list[int]) -> DataFrame:
    """set_i, set_j, fst, fst_max of every pair of sets, by analysis of molecular variance from allele counts alone.

    fst_max is the FST with alleles made private to their set, the largest possible: two sets then have no value in
    common, and nothing else changes, so both come from the same counts.
    """
    counts = _long(wide, markers, ("set_id",)).groupBy("set_id", "locus", "v").agg(F.count("*").cast("double").alias("c"))
    per = counts.groupBy("set_id").agg((F.sum("c") / len(markers)).alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    # s: loci at which pairs of samples differ, summed. Sets meet in a row for each pair of sets.
    sets = per.select(F.struct("set_id", "n", (len(markers) * F.col("n") * F.col("n") - F.col("same")).alias("s")).alias("e")).agg(F.collect_list("e").alias("e"))
    grid = sets.select(F.explode("e").alias("a"), "e").select("a", F.explode("e").alias("b")).filter("a.set_id < b.set_id")
    grid = grid.select(F.col("a.set_id").alias("set_i"), F.col("b.set_id").alias("set_j"), F.col("a.n").alias("ni"), F.col("b.n").alias("nj"), F.col("a.s").alias("si"), F.col("b.s").alias("sj"))
    values = counts.groupBy("locus", "v").agg(F.array_sort(F.collect_list(F.struct("set_id", "c"))).alias("e"))  # at most a row's worth of sets
    couples = values.select(F.explode("e").alias("a"), "e").select("a", F.explode("e").alias("b")).filter("a.set_id < b.set_id")
    shared = couples.groupBy(F.col("a.set_id").alias("set_i"), F.col("b.set_id").alias("set_j")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("same"))
    rows = grid.join(shared, ["set_i", "set_j"], "left")
    n, whole = F.col("ni") + F.col("nj"), len(markers) * F.col("ni") * F.col("nj")

    def value(between: Column) -> Column:
        within = F.try_divide(F.col("si"), 2 * F.col("ni")) + F.try_divide(F.col("sj"), 2 * F.col("nj"))
        total = (F.col("si") + F.col("sj") + 2 * between) / (2 * n)
        sb = F.try_divide(within, n - 2)
        sa = F.try_divide(total - within - sb, n - (F.col("ni") * F.col("ni") + F.col("nj") * F.col("nj")) / n)
        return F.try_divide(sa, sa + sb)

    return rows.select("set_i", "set_j", value(whole - F.coalesce("same", F.lit(0.0))).alias("fst"), value(whole).alias("fst_max"))


def fst(wide: DataFrame, markers: list[int]) -> DataFrame:
    """set_i, set_j, fst of every pair of sets."""
    return fst_both(wide, markers).select("set_i", "set_j", "fst")


def recode_private(wide: DataFrame, markers: list[int], sets: list[str]) -> DataFrame:
    """Alleles made private to their set, for the largest FST possible: set index * 1000 + value."""
    index = F.coalesce(*[F.when(F.col("set_id") == s, F.lit(i)) for i, s in enumerate(sets, 1)], F.lit(0))
    return wide.select("set_id", "sample_id", *[(index * 1000 + F.col(f"m{m}")).alias(f"m{m}") for m in markers])


def standardized_fst(observed: DataFrame, largest: DataFrame) -> DataFrame:
    top = largest.select("set_i", "set_j", F.col("fst").alias("top"))
    return observed.join(top, ["set_i", "set_j"]).select("set_i", "set_j", F.try_divide("fst", F.nullif("top", F.lit(0.0))).alias("fst_std"))


def fst_standardized(wide: DataFrame, markers: list[int]) -> DataFrame:
    """set_i, set_j, fst_std: FST over the largest possible one, in one pass."""
    return fst_both(wide, markers).select("set_i", "set_j", F.try_divide("fst", F.nullif("fst_max", F.lit(0.0))).alias("fst_std"))


def fst_pvalue(wide: DataFrame, markers: list[int], rounds: int = 100, seed: int = 1) -> DataFrame:
    """set_i, set_j, p: (1 + deals with at least the observed FST) / (1 + rounds), samples dealt anew to the two sets.

    A deal needs only how often each genotype occurs in the two sets: it is drawn from these counts. Pairs of sets are
    dealt to tasks; a pair of more than GENOTYPES_LIMIT distinct genotypes is an error.
    """
    ship(wide.sparkSession)
    values = F.array(*[F.col(f"m{m}").cast("double") for m in markers])
    kept = wide.dropna(subset=[f"m{m}" for m in markers])
    per = kept.groupBy("set_id", values.alias("g")).agg(F.count("*").alias("c"))
    sizes = per.groupBy("set_id").agg(F.count("*").alias("k"))
    i, j = (sizes.select(F.col("set_id").alias(f"set_{x}"), F.col("k").alias(f"k_{x}")) for x in "ij")
    couples = i.join(j, F.col("set_i") < F.col("set_j"))  # a row for each pair of sets
    too_many = F.raise_error(F.lit(f"more than {GENOTYPES_LIMIT} genotypes in a pair of sets"))
    couples = couples.withColumn("ok", F.when(F.col("k_i") + F.col("k_j") > GENOTYPES_LIMIT, too_many.cast("boolean")).otherwise(True)).filter("ok")
    sides = [per.withColumnRenamed("set_id", f"set_{x}").join(F.broadcast(couples.select("set_i", "set_j")), f"set_{x}").withColumn("side", F.lit(s)) for s, x in enumerate("ij")]
    both = sides[0].select("set_i", "set_j", "g", "c", "side").unionByName(sides[1].select("set_i", "set_j", "g", "c", "side"))
    gathered = both.groupBy("set_i", "set_j").agg(F.collect_list(F.struct("g", "c", "side")).alias("rows"))

    def value(a: np.ndarray, b: np.ndarray, codes: list[np.ndarray]) -> float:
        """FST of two sets with these counts of each genotype."""
        na, nb = float(a.sum()), float(b.sum())
        n = na + nb

        def unlike(x, y):
            """Differing loci, summed over pairs of x and y."""
            return len(codes) * x.sum() * y.sum() - sum(float(np.bincount(k, x) @ np.bincount(k, y)) for k in codes)

        within = unlike(a, a) / (2 * na) + unlike(b, b) / (2 * nb)
        sb = within / (n - 2) if n > 2 else np.nan
        sa = (unlike(a + b, a + b) / (2 * n) - within - sb) / (n - (na * na + nb * nb) / n)
        return sa / (sa + sb) if sa + sb else np.nan

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x, y, rows in zip(f["set_i"], f["set_j"], f["rows"]):
                place = {g: k for k, g in enumerate(sorted({tuple(r["g"]) for r in rows}))}
                counts = np.zeros((2, len(place)), np.int64)
                for r in rows:
                    counts[r["side"], place[tuple(r["g"])]] += r["c"]
                table = np.array(list(place))
                codes = [np.unique(table[:, m], return_inverse=True)[1] for m in range(table.shape[1])]
                rng = np.random.default_rng([seed, zlib.crc32(f"{x}|{y}".encode())])
                every, size = counts.sum(axis=0), int(counts[0].sum())
                least = value(counts[0].astype(float), counts[1].astype(float), codes)
                hits = 0
                for _ in range(rounds):
                    own = rng.multivariate_hypergeometric(every, size, method="marginals")
                    hits += value(own.astype(float), (every - own).astype(float), codes) >= least - 1e-12
                out.append((x, y, (1 + hits) / (1 + rounds)))
            yield pd.DataFrame(out, columns=["set_i", "set_j", "p"])

    kind = wide.schema["set_id"].dataType.simpleString()
    return gathered.mapInPandas(deal, f"set_i {kind}, set_j {kind}, p double")


def fst_table(wide: DataFrame, markers: list[int], rounds: int = 100) -> DataFrame:
    """set_i, set_j, fst, p of every pair of sets."""
    return fst(wide, markers).join(fst_pvalue(wide, markers, rounds), ["set_i", "set_j"])


def principal_components(rows: DataFrame, columns: list[str], k: int = 2, key: str = "sample_id") -> DataFrame:
    """key, pc1..pck, eigenvalue and share: principal components of numeric columns (complete rows).

    The covariance is gathered as sums of products, so the driver sees a matrix of columns by columns only.
    """
    kept = rows.dropna(subset=columns)
    sums = kept.agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j],
    ).first()
    n = max(sums["n"], 1)
    mean = np.array([(sums[f"s_{c}"] or 0.0) / n for c in columns])
    cov = np.array([[(sums[f"p_{min(i, j)}_{max(i, j)}"] or 0.0) / n - mean[i] * mean[j] for j in range(len(columns))] for i in range(len(columns))])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
    out = [sum(((F.col(c) - float(m)) * float(v) for c, m, v in zip(columns, mean, vectors[:, q])), F.lit(0.0)).alias(f"pc{q + 1}") for q in range(len(order))]
    share = [F.lit(float(values[o] / max(values.sum(), 1e-300))).alias(f"share{q + 1}") for q, o in enumerate(order)]
    return kept.select(key, *out, *share)


def krylov_components(times: Callable[[np.ndarray], np.ndarray], share: np.ndarray, n: float, k: int, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the k largest solutions of G S x = value x with x' S x = 1, where S = G - n share share'.

    G is only known by its products `times` with a few columns. A block Lanczos method with full orthogonalisation: the
    space grows by the products of its last block, and the best solutions within it are taken, until they stay the same.
    """
    size, wide = len(share), min(len(share), k + 4)
    block = np.linalg.qr(np.random.default_rng(1).normal(size=(size, wide)))[0]
    space, s_space, m_space = (np.zeros((size, 0)) for _ in range(3))
    last = None
    for _ in range(steps):
        s_block = times(block) - n * np.outer(share, share @ block)
        m_block = times(s_block)
        space, s_space, m_space = np.hstack([space, block]), np.hstack([s_space, s_block]), np.hstack([m_space, m_block])
        metric, power = space.T @ s_space, s_space.T @ m_space
        scale, axes = np.linalg.eigh((metric + metric.T) / 2)
        keep = scale > max(1e-11 * scale.max(), 1e-12 * n)
        if not keep.any():
            return np.zeros(0), np.zeros((size, 0))
        white = axes[:, keep] / np.sqrt(scale[keep])
        found, turned = np.linalg.eigh(white.T @ ((power + power.T) / 2) @ white)
        order = np.argsort(found)[::-1][:k]
        values, inside = np.maximum(found[order], 1e-300), white @ turned[:, order]
        if last is not None and len(last) == len(values) and np.abs(values - last).max() <= 1e-12 * values.max():
            break
        last = values
        rest = m_block
        for _ in range(2):
            rest = rest - space @ (space.T @ rest)
        q, r = np.linalg.qr(rest)
        block = q[:, np.abs(np.diag(r)) > 1e-10 * max(np.abs(m_block).max(), 1e-300)]
        if not block.shape[1] or space.shape[1] >= size:
            break
    return values, (m_space @ inside) / values


def distance_components(wide: DataFrame, markers: list[int], k: int = 2, key: str = "sample_id", dense: int = DENSE_LIMIT) -> DataFrame:
    """key, pc1..pck, value1..valuek: principal components of the matrix of distances of all complete samples, whose
    rows are the observations and whose distances are shares of differing markers. value is the component's variance.

    The matrix is never made. A distance is 1 less the shared alleles over the markers, so with one column for each
    allele the matrix is a product of that table with itself, and its components follow from how often two alleles occur
    together. Up to `dense` alleles these counts are gathered; with more they stay a table, and its products with a few
    columns, a number an allele each, are joins and sums.
    """
    size = len(markers)
    loci = _long(wide, markers, (key,))
    seen = sorted((r["locus"], r["v"], r["c"]) for r in loci.groupBy("locus", "v").agg(F.count("*").alias("c")).collect())  # a row an allele
    kept = wide.dropna(subset=[f"m{m}" for m in markers])
    n = sum(c for _, _, c in seen) / size
    if n < 2:
        return kept.filter("false").select(key, *[F.lit(0.0).alias(f"{c}{q}") for q in range(1, k + 1) for c in ("pc", "value")])
    names = [(m, v) for m, v, _ in seen]
    share = np.array([c for _, _, c in seen]) / n
    k = min(k, len(names))
    pairs = [F.struct(F.lit(a).alias("k"), F.col(f"m{a}").alias("v"), F.lit(b).alias("l"), F.col(f"m{b}").alias("w")) for i, a in enumerate(markers) for b in markers[: i + 1]]
    together = kept.select(F.inline(F.array(*pairs))).groupBy("k", "v", "l", "w").agg(F.count("*").alias("c"))
    if len(names) <= dense:
        place = {x: i for i, x in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        for r in together.collect():  # pairs of alleles
            i, j = place[r["k"], r["v"]], place[r["l"], r["w"]]
            g[i, j] = g[j, i] = r["c"]
        values, vectors = np.linalg.eigh(g - n * np.outer(share, share))
        root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
        own, axes = np.linalg.eigh(root @ g @ root)
        order = np.argsort(own)[::-1][:k]
        own = np.maximum(own[order], 1e-300)
        found = (g @ root @ axes[:, order]) / own
    else:
        spark = wide.sparkSession
        known = spark.createDataFrame([(int(m), float(v), i) for i, (m, v) in enumerate(names)], "locus int, v double, id int")
        first = known.select(F.col("locus").alias("k"), "v", F.col("id").alias("i"))
        second = known.select(F.col("locus").alias("l"), F.col("v").alias("w"), F.col("id").alias("j"))
        one = together.join(first, ["k", "v"]).join(second, ["l", "w"]).select("i", "j", F.col("c").cast("double").alias("c"))
        table = cut(one.unionByName(one.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "c")))

        def times(block: np.ndarray) -> np.ndarray:
            columns = spark.createDataFrame(pd.DataFrame(block, columns=[f"y{q}" for q in range(block.shape[1])]).assign(j=np.arange(len(block), dtype=np.int32)))
            summed = table.join(columns, "j").groupBy("i").agg(*[F.sum(F.col("c") * F.col(f"y{q}")).alias(f"y{q}") for q in range(block.shape[1])]).toPandas()
            out = np.zeros_like(block)
            out[summed["i"].to_numpy()] = summed[[f"y{q}" for q in range(block.shape[1])]].to_numpy()
            return out

        own, found = krylov_components(times, share, n, k)
        discard(table)
    # Where samples don't vary there is no component: all zero.
    known = own > 1e-12 * n * n
    own, found = np.where(known, own, 0.0), np.where(known, found, 0.0)
    own, found = np.append(own, np.zeros(k - len(own))), np.hstack([found, np.zeros((len(names), k - found.shape[1]))])
    load = -np.sqrt(own) * found / size
    load -= share @ load / size  # centred, a sample having `size` alleles
    load *= np.sign(load[np.abs(load).argmax(axis=0), range(k)])
    # A row an allele, joined once for each marker.
    rows = [(int(m), float(v), w) for (m, v), w in zip(names, load.tolist())]
    loads = wide.sparkSession.createDataFrame(rows, "locus bigint, v double, w array<double>")
    parts = kept.select(key, *[F.col(f"m{m}").cast("double").alias(f"m{m}") for m in markers])
    for m in markers:
        parts = parts.join(loads.filter(F.col("locus") == m).select(F.col("v").alias(f"m{m}"), F.col("w").alias(f"w{m}")), f"m{m}")
    out = [sum((F.get(f"w{m}", F.lit(q)) for m in markers), F.lit(0.0)).alias(f"pc{q + 1}") for q in range(k)]
    return parts.select(key, *out, *[F.lit(float(x / size**2 / (n - 1))).alias(f"value{q + 1}") for q, x in enumerate(own)])


def jittered(rows: DataFrame, column: str, seed: int = 1) -> DataFrame:
    """The column with normal noise, so that equal points part: its scale is half the number of rows, times the least
    distance of different values over the largest. Equal seeds give equal noise for equal partitions."""
    values = numbered(rows.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct(), ["v"])
    after = values.select((F.col("number") - 1).alias("number"), F.col("v").alias("w"))
    gaps = values.join(after, "number").agg(F.min(F.col("w") - F.col("v")).alias("least"))
    span = values.agg((F.max("v") - F.min("v")).alias("most"))
    least, most, n = gaps.first()["least"], span.first()["most"], rows.count()
    scale = least / most * n / 2 if most else 0.0
    return rows.withColumn(column, F.col(column) + F.lit(float(scale)) * F.randn(seed))


def distance_index(wide: DataFrame, dim: DataFrame, markers: list[int]) -> DataFrame:
    """position, set_id, label, colour, sample_id: the order of the samples in a matrix of distances, set after set."""
    kept = wide.dropna(subset=[f"m{m}" for m in markers]).select("set_id", "sample_id").join(F.broadcast(dim.select("set_id", "label", "colour")), "set_id")
    return numbered(kept, ["set_id", "sample_id"]).select((F.col("number") - 1).alias("position"), "set_id", "label", "colour", "sample_id")


def distance_slices(index: DataFrame) -> DataFrame:
    """set_id, start, n of each set's samples in the order."""
    return index.groupBy("set_id").agg(F.min("position").alias("start"), F.count("*").alias("n"))


def neighbour_joining(names: list, d: np.ndarray) -> list[tuple[str, str, float]]:
    """(child, parent, length) of the tree by Saitou and Nei's method; inner nodes are n1, n2, ..."""
    if len(names) > DENSE_LIMIT:
        raise ValueError(f"a tree of more than {DENSE_LIMIT} tips: take distinct genotypes or sets instead")
    names, d, edges, made = [str(x) for x in names], np.array(d, float), [], 0
    while len(names) > 2:
        n = len(names)
        total = d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(q.argmin(), q.shape))
        made += 1
        node = f"n{made}"
        li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        edges += [(names[i], node, float(li)), (names[j], node, float(d[i, j] - li))]
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], new[keep]]), np.append(new[keep], 0.0)])
        names = [names[k] for k in keep] + [node]
    if len(names) == 2:
        edges.append((names[0], names[1], float(d[0, 1])))
    return edges


def set_distances(wide: DataFrame, markers: list[int]) -> DataFrame:
    """set_i, set_j, d: the mean share of differing markers between samples of two sets, from counts."""
    counts = _long(wide, markers, ("set_id",)).groupBy("set_id", "locus", "v").agg(F.count("*").cast("double").alias("c"))
    share = counts.withColumn("f", F.col("c") / F.sum("c").over(Window.partitionBy("set_id", "locus")))
    a, b = share.select(F.col("set_id").alias("set_i"), "locus", "v", "f"), share.select(F.col("set_id").alias("set_j"), "locus", "v", F.col("f").alias("g"))
    return a.join(b, ["locus", "v"]).filter("set_i <> set_j").groupBy("set_i", "set_j").agg((1 - F.sum(F.col("f") * F.col("g")) / len(markers)).alias("d"))


def set_tree(wide: DataFrame, markers: list[int]) -> DataFrame:
    """child, parent, length: the neighbour-joining tree of sets."""
    rows = set_distances(wide, markers).collect()  # a row for each pair of sets
    names = sorted({r["set_i"] for r in rows})
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[names.index(r["set_i"]), names.index(r["set_j"])] = r["d"]
    return wide.sparkSession.createDataFrame(neighbour_joining(names, d) if names else [], "child string, parent string, length double")


def sample_tree(wide: DataFrame, markers: list[int], key: str = "sample_id") -> DataFrame:
    """child, parent, length: the neighbour-joining tree of all complete samples, by shares of differing markers rounded
    to three digits. At most DENSE_LIMIT samples."""
    rows = wide.dropna(subset=[f"m{m}" for m in markers]).select(F.col(key).cast("string").alias("k"), *[f"m{m}" for m in markers]).orderBy(key).limit(DENSE_LIMIT + 1).collect()
    x = np.array([[r[f"m{m}"] for m in markers] for r in rows], float).reshape(len(rows), len(markers))
    if len(rows) > DENSE_LIMIT:
        raise ValueError(f"a tree of more than {DENSE_LIMIT} tips: take distinct genotypes or sets instead")
    d = np.zeros((len(rows), len(rows)))
    for column in x.T:
        d += column[:, None] != column[None, :]
    edges = neighbour_joining([r["k"] for r in rows], np.round(d / len(markers), 3))
    return wide.sparkSession.createDataFrame(edges, "child string, parent string, length double")


def newick(edges: list[tuple[str, str, float]]) -> str:
    """The tree in Newick's notation, from the node that is nobody's child; lengths with six digits."""
    below: dict[str, list[tuple[str, float]]] = {}
    for child, parent, length in edges:
        below.setdefault(parent, []).append((child, length))
    tops = set(below) - {c for c, _, _ in edges}
    if not tops:
        return ";"
    # Children before their parents, so that long chains need no recursion.
    order, todo = [], [min(tops)]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c, _ in below.get(node, ())]
    text: dict[str, str] = {}
    for node in reversed(order):
        inner = ",".join(f"{text.pop(c)}:{length:.6f}" for c, length in below.get(node, ()))
        text[node] = f"({inner})" if inner else node
    return text[order[0]] + ";"


def coloured_tree(edges: DataFrame, classes: DataFrame, other: str = "black") -> DataFrame:
    """child, parent, length, colour: a branch has the colour that all tips below it share, else `other`; negative lengths
    become 0. classes: tip, colour; tips without one have `other`, and an inner node may have one too.

    The least and the largest colour below each node are found by doubling: every round a node passes what lies within a
    distance to the ancestor at that distance, and the distance doubles. So a tree of any shape takes as many rounds as
    the logarithm of its depth, all joins and partial aggregates.
    """
    up = edges.select(F.col("child").alias("node"), F.col("parent").alias("above"))
    nodes = up.unionByName(edges.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("above"))).groupBy("node").agg(F.max("above").alias("above"))
    inner = edges.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    own = classes.groupBy(F.col("tip").alias("node")).agg(F.min("colour").alias("own"))
    state = nodes.join(own, "node", "left").join(inner, "node", "left")
    colour = F.when(F.col("inner").isNull(), F.coalesce("own", F.lit(other))).otherwise(F.col("own"))
    state = cut(state.select("node", "above", colour.alias("low"), colour.alias("high")))
    while not state.filter("above IS NOT NULL").isEmpty():
        passed = state.filter("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(F.min("low").alias("low2"), F.max("high").alias("high2"))
        farther = state.select(F.col("node").alias("above"), F.col("above").alias("next"))
        after = state.join(passed, "node", "left").join(farther, "above", "left")
        before, state = state, cut(after.select("node", F.col("next").alias("above"), F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
        discard(before)
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(other)
    found = state.select(F.col("node").alias("child"), one.alias("colour"))
    return edges.join(found, "child").select("child", "parent", F.greatest("length", F.lit(0.0)).alias("length"), "colour")
