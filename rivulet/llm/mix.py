"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.session import cut

#: Each level of refinement reads so many further bits of the hash.
BITS = 10
LEVELS = 6
#: A budget is met if it is missed by no more than this share of it.
TOLERANCE = 0.002
#: The boundary is refined until so many records are left around it, two numbers each, which are then looked at one by one.
AROUND = 100_000


@dataclass(frozen=True)
class Budget:
    """What one source contributes: every record full times, and once more the records with a hash below threshold or among picks."""

    source: str
    size: int
    target_share: float
    max_repeats: int
    wanted: float
    full: int
    threshold: int
    picks: tuple[int, ...]
    extra: int


def _hash(key: Column) -> Column:
    """An order of all records that is spread evenly: 60 bits of a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), key), 64 - BITS * LEVELS)


def _of_source(values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[x for s, v in sorted(values.items()) for x in (F.lit(s), F.lit(int(v)).cast("bigint"))]), F.col("source"))


@dataclass
class _Search:
    """Of one source: the tokens wanted beyond whole copies, those taken below the boundary, and the bucket that it lies in."""

    left: float
    slack: float
    taken: int = 0
    bucket: int = 0
    threshold: int = 0
    picks: list[int] = field(default_factory=list)


def _refine(at: DataFrame, open_: dict[str, _Search]) -> DataFrame | None:
    """Find the bucket of each source in which the running sum of tokens, in hash order, passes what is wanted.

    Each level is a histogram of tokens by source and hash bucket, with 2**BITS rows for each source at most; only the
    boundary bucket and the one behind it are read further. Sources that never pass what is wanted are closed. The
    records around the boundaries are returned once they are few.
    """
    whole = 1 << (BITS * LEVELS)
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = at.where(F.col("source").isin(*sorted(open_))).groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
        near = 0
        by_source: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["bucket"]):
            by_source.setdefault(r["source"], []).append(r)
        for s in list(open_):
            x = open_[s]
            for r in by_source.get(s, []):
                if x.taken + r["n"] > x.left:
                    x.bucket = r["bucket"]
                    break
                x.taken += r["n"]
            else:  # what is wanted takes all records
                x.threshold = whole
                del open_[s]
                continue
            near += sum(r["rows"] for r in by_source[s] if 0 <= r["bucket"] - x.bucket <= 1)
        if not open_:
            return None
        at = at.where(F.col("source").isin(*sorted(open_)) & (F.shiftright("h", shift) - _of_source({s: x.bucket for s, x in open_.items()})).between(0, 1))
        if near <= AROUND or level == LEVELS:
            return at.groupBy("source", "h").agg(F.sum("n_tokens").alias("n"))  # records with equal ids are taken together
        if level == 1:
            at = cut(at)  # about a 500th of the rows; all further levels read these
    return None


def _settle(x: _Search, rows: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Set the threshold at the record that passes what is wanted, then fill up with the largest records behind it that still fit.

    The record at the boundary is returned, with its tokens, if there is one.
    """
    boundary = None
    for h, n in sorted(rows):
        if x.taken + n > x.left:
            boundary = (h, n)
            break
        x.taken += n
    x.threshold = boundary[0] if boundary else max(h for h, _ in rows) + 1
    behind = sorted(((n, -h) for h, n in rows if h >= x.threshold), reverse=True)
    for n, h in behind:
        if x.left - x.taken <= x.slack:
            break
        if x.taken + n <= x.left + x.slack:
            x.picks.append(-h)
            x.taken += n
    return boundary


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> list[Budget]:
    """The budget of each source of targets that has any tokens. sized: source, n_tokens, h.

    The total is given, or the largest one at which every source can still contribute its share within its cap. A source
    asked for more than its cap contributes the cap. What a budget needs beyond whole copies is taken in hash order up to
    a threshold; the rest, less than the record at the boundary, is filled with the largest records behind it that fit,
    until TOLERANCE is met: from those around the boundary, else from all others of the source. Where none fits, the
    record at the boundary is taken if that misses the budget by less.
    """
    plan = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect() if r["source"] is not None}
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if r["n"]}
    live = {s: (*plan[s], sizes[s]) for s in plan if s in sizes and plan[s][0] and plan[s][0] > 0 and (plan[s][1] or 0) > 0}
    if not live:
        return []
    if total is None:
        total = int(min(n * cap / share for share, cap, n in live.values()))
    wanted = {s: min(share * total, float(n * cap)) for s, (share, cap, n) in live.items()}
    full = {s: int(wanted[s] // live[s][2]) for s in live}
    search = {s: _Search(wanted[s] - full[s] * live[s][2], TOLERANCE * wanted[s]) for s in live}
    open_ = {s: x for s, x in search.items() if x.left > x.slack}
    around = _refine(sized, open_) if open_ else None
    if around is not None:
        by_source: dict[str, list[tuple[int, int]]] = {s: [] for s in open_}
        for r in around.collect():  # AROUND records at most, but for records that share all bits of their hash
            by_source[r["source"]].append((r["h"], r["n"]))
        boundary = {s: _settle(open_[s], by_source[s]) for s in sorted(open_)}
        _fill_from_rest(sized, {s: (x, max(h for h, _ in by_source[s])) for s, x in open_.items() if x.left - x.taken > x.slack})
        for s, x in open_.items():
            under = x.left - x.taken
            if under > x.slack and boundary[s] and boundary[s][0] not in x.picks and boundary[s][1] - under < under:
                x.picks.append(boundary[s][0])
                x.taken += boundary[s][1]
    return [Budget(s, live[s][2], live[s][0], live[s][1], wanted[s], full[s], x.threshold, tuple(x.picks), x.taken) for s, x in sorted(search.items())]


def _fill_from_rest(sized: DataFrame, open_: dict[str, tuple[_Search, int]]) -> None:
    """Of the records behind those around the boundary, again and again the largest one that fits; each pass is one aggregate."""
    while open_:
        fits = F.col("n_tokens") <= _of_source({s: int(x.left - x.taken + x.slack) for s, (x, _) in open_.items()})
        behind = F.col("h") > _of_source({s: h for s, (_, h) in open_.items()})
        new = F.lit(True)
        for s, (x, _) in open_.items():
            if x.picks:
                new = new & ~((F.col("source") == s) & F.col("h").isin(*x.picks))
        rows = sized.where(F.col("source").isin(*sorted(open_)) & behind & new)
        rows = rows.groupBy("source", "h").agg(F.sum("n_tokens").alias("n_tokens")).where(fits)
        best = {r["source"]: r["b"] for r in rows.groupBy("source").agg(F.max(F.struct("n_tokens", "h")).alias("b")).collect()}
        for s in list(open_):
            x = open_[s][0]
            if s in best:
                x.picks.append(best[s]["h"])
                x.taken += best[s]["n_tokens"]
            if s not in best or x.left - x.taken <= x.slack:
                del open_[s]


def mix(sized: DataFrame, targets: DataFrame, id_col: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, n_tokens, copies) and the report by source.

    sized has id_col, source and n_tokens of every record; records of sources that targets does not list, of null source
    and without tokens are left out. Whole records are taken, so a share can miss its target by part of a record.
    Records are taken in the order of a hash of their id: equal ids are taken together. Nothing is sorted: membership
    is a comparison with a threshold and a few picked records for each source. Report: source, size, target_share, max_repeats, tokens, actual_share,
    repeats (the most often that a record is used). A listed source without tokens is reported with none.
    """
    at = cut(
        sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select(
            F.col(id_col).alias("_id"), "source", "n_tokens", _hash(F.col(id_col)).alias("h")
        )
    )
    plan = budgets(at, targets, total)
    spark = at.sparkSession
    rows = [(b.source, b.full, b.threshold, list(b.picks), b.size) for b in plan]
    known = spark.createDataFrame(rows, "source string, full int, threshold bigint, picks array<bigint>, size bigint")
    more = (F.col("h") < F.col("threshold")) | F.array_contains("picks", F.col("h"))
    copies = F.col("full") + more.cast("int")
    chosen = (
        at.join(F.broadcast(known), "source")  # one row for each listed source
        .select(F.col("_id").alias(id_col), "source", "n_tokens", copies.alias("copies"))
        .where("copies > 0")
    )
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats")
    )
    report = (
        targets.join(F.broadcast(known.select("source", "size")), "source", "left")
        .join(used, "source", "left")
        .select(
            "source",
            F.coalesce("size", F.lit(0)).alias("size"),
            "target_share",
            "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("repeats", F.lit(0)).alias("repeats"),
        )
    )
    total_used = used.agg(F.sum("tokens").alias("t"))
    return chosen, report.withColumn("actual_share", F.col("tokens") / total_used.scalar())
