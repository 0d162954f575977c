"""Operator 10, secret scans with multipart credential linking (DataFrame functions only).

Base finders report by themselves. The parts of a split credential (access identifier, secret body, endpoint) are too common to report
alone: two sweeps over the parts of each text, sorted by place, join every weak secret body with the identifiers and endpoints whose
interval lies within its scope, and reports it only when such a part co-occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm.common import let, safe_text, table

#: Kind, pattern, group that is the secret, least length of that group. Kinds in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Weak secret bodies (30 or more characters of mixed classes, checked below) and endpoints.
WEAK = r"[A-Za-z0-9+/_-]{30,}={0,2}"
ENDPOINT = r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
DOMAIN = r"\.(?:com|net|org|io|cloud|internal)[.-]*$"
#: Elements of an array that are gone through together: what grows by appending stays this short.
CHUNK = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(items: Column, zero: Column, absorb, emit) -> Column:
    """All of emit(state, item), arrays, in order; the state starts at zero and is absorb(state, item) after each item.

    In chunks, as an array that grows by one element is copied each time: first the state before each chunk, then each chunk by itself.
    """

    def over(chunks: Column) -> Column:
        before = F.aggregate(
            chunks, F.struct(zero.alias("s"), F.slice(F.array(zero), 1, 0).alias("out")),
            lambda acc, c: F.struct(F.aggregate(c, acc["s"], absorb).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"],
        )

        def through(c: Column, s: Column) -> Column:
            none = F.slice(emit(s, F.get(c, F.lit(0))), 1, 0)
            return F.aggregate(c, F.struct(s.alias("s"), none.alias("out")), lambda acc, x: F.struct(absorb(acc["s"], x).alias("s"), F.concat(acc["out"], emit(acc["s"], x)).alias("out")), lambda acc: acc["out"])

        return F.flatten(F.zip_with(chunks, before, through))

    def chunked(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, CHUNK))

    return let(items, lambda x: let(chunked(x), over))


def spans_of(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans in code points: between two matches lies what split() returns."""

    def found(matches: Column) -> Column:
        def emit(at: Column, m: Column) -> Column:
            start = at + m["gap"]
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + m["len"]).alias("end"), F.lit(kind).alias("kind"))
            return F.when(m["ok"], F.array(span)).otherwise(F.array().cast(SPAN))

        def sized(between: Column) -> Column:
            ok = F.lit(True) if keep is None else None
            return F.transform(matches, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(m).alias("len"), (keep(m) if ok is None else ok).alias("ok")))

        return F.when(F.size(matches) == 0, F.array().cast(SPAN)).otherwise(scan(let(F.split(text, pattern, -1), sized), F.lit(0), lambda at, m: at + m["gap"] + m["len"], emit))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _mixed(m: Column) -> Column:
    return m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")


def _linked(base: Column, weak: Column, ends: Column, scope: int) -> Column:
    """Weak bodies that no base span overlaps, with an access identifier within `scope` code points, or with both an endpoint and an assignment."""
    far, kinds = 10**9, ("access", "endpoint", "assign")

    def sweep(parts: Column, forward: bool) -> Column:
        """For each weak part in order, whether parts of each kind end (start) within scope on one side, and whether a base span reaches in."""
        edge, nearer = ("end", F.greatest) if forward else ("start", F.least)

        def absorb(s: Column, p: Column) -> Column:
            near = [F.when(p["kind"] == k, nearer(s[k], p[edge])).otherwise(s[k]).alias(k) for k in kinds]
            return F.struct(*near, F.when(p["rank"] < 8, nearer(s["base"], p[edge])).otherwise(s["base"]).alias("base"))

        def emit(s: Column, p: Column) -> Column:
            def gap(k: str) -> Column:
                return p["start"] - s[k] if forward else s[k] - p["end"]

            hit = F.array(F.struct(p["start"].alias("start"), p["end"].alias("end"), *((gap(k) <= scope).alias(k) for k in kinds), (gap("base") < 0).alias("covered")))
            return F.when(p["kind"] == "linked", hit).otherwise(F.slice(hit, 1, 0))

        zero = F.struct(*(F.lit(-far if forward else far).alias(k) for k in (*kinds, "base")))
        return scan(parts, zero, absorb, emit) if forward else F.reverse(scan(F.reverse(parts), zero, absorb, emit))

    def verdict(parts: Column) -> Column:
        def both(x: Column, y: Column) -> Column:
            near = {k: x[k] | y[k] for k in kinds}
            ok = ~(x["covered"] | y["covered"]) & (near["access"] | (near["endpoint"] & near["assign"]))
            return F.struct(x["start"].alias("start"), F.lit(9).alias("rank"), x["end"].alias("end"), F.lit("linked").alias("kind"), ok.alias("ok"))

        hits = F.filter(F.zip_with(sweep(parts, True), sweep(parts, False), both), lambda p: p["ok"])
        return F.transform(hits, lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind")))

    return F.when(F.size(weak) == 0, F.array().cast(SPAN)).otherwise(let(F.sort_array(F.concat(base, weak, ends)), verdict))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per input row: id, `base` and `spans` (arrays of struct(start, rank, end, kind), sorted: by start, then kind).

    Spans count code points, end exclusive, over whole texts. Defined results: a null text is empty and has no spans; ids are passed
    through (null and repeated ones too); an empty table gives no rows; other columns are not read.
    """
    text = F.col("t")
    src = docs.select(F.col(id_col).alias("doc_id"), safe_text(text_col).alias("t"))
    keep = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6,
        "access": lambda m: F.length(m) >= 20,
        "hex": None,
    }
    # a greedy run of one class is maximal, so the length can stand in the pattern and short runs need no span
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": r"[0-9a-f]{24,}"}
    base = F.sort_array(F.concat(*(spans_of(text, patterns[k], k, i, keep[k]) for i, (k, *_) in enumerate(BASE))))
    found = src.select("doc_id", "t", base.alias("base"), spans_of(text, WEAK, "linked", 9, _mixed).alias("weak"))
    # endpoints matter only where a weak body waits for one
    found = found.select("doc_id", "base", "weak", F.when(F.size("weak") == 0, F.array().cast(SPAN)).otherwise(spans_of(text, ENDPOINT, "endpoint", 8, lambda m: m.rlike(DOMAIN))).alias("ends"))
    return found.select("doc_id", "base", F.sort_array(F.concat(F.col("base"), _linked(F.col("base"), F.col("weak"), F.col("ends"), scope))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(counted, ("assign", "access", "hex")), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
