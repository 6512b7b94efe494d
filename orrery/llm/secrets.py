"""Secret scans: patterns of their own, and multipart credentials linked by an interval join. DataFrame functions only.

Certain findings (assign, access, hex) are reported wherever they stand. Weak candidates (an identifier, a key-like word, an
endpoint) are reported only where their complementary parts lie in one scope with them: in the same block of lines, blank
lines parting blocks, and within reach characters. The interval join of parts runs inside the row of their document, whose
parts never leave it, as a sweep: ends and starts in the order of their places, carrying the last complementary part. So
it needs no shuffle, one text's parts are all that a task ever holds, and n of them cost n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_names, table

#: Kinds, in the order of equal starts, with pattern, group to be measured and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more: the same matches as of runs of any length
}
#: Weak candidates: what may identify an account, be a key, and be an endpoint.
WEAK = {
    "identifier": (r"""(?i)\b(?:access_?key_?id|client_?id|account|login|user_?name|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", 1, 3),
    "key": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"""(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{4,}""", 0, 7),
}
KINDS = [*BASE, *WEAK]
#: A text without these has no match of the kind, which is cheaper to see than the pattern.
NEEDS = {"assign": r"[:=]", "access": "AKIA", "identifier": r"[:=]", "endpoint": "://"}
BLANK_LINE = r"\n[\x20\t]*\n"
REACH, BLOCK = 300, 256
MASK = "[SECRET]"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,part:string>>"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once: higher-order functions compute what they mention twice twice."""
    return F.get(F.transform(F.array(x), use), 0)


def swept(items: Column, state: dict[str, tuple[str, Callable[[Column, Column], Column]]], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """What out(state, item) gives for each item of an array, in order, where it isn't null. state: name -> (type, next(state, item)).

    In blocks, as appending to a long array copies it.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    first = lambda made: F.struct(*[F.lit(None).cast(t).alias(n) for n, (t, _) in state.items()], made.alias("made"))

    def step(acc: Column, x: Column) -> Column:
        return once(out(acc, x), lambda o: F.struct(*[then(acc, x).alias(n) for n, (_, then) in state.items()], F.when(o.isNull(), acc["made"]).otherwise(F.array_append(acc["made"], o)).alias("made")))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(*[acc[n].alias(n) for n in state], none.alias("made")), step)
        return once(inner, lambda r: F.struct(*[r[n].alias(n) for n in state], F.array_append(acc["made"], r["made"]).alias("made")))

    return F.flatten(F.aggregate(F.when(F.size(items) > 0, blocks).otherwise(F.array().cast("array<array<struct<at:bigint,order:int,side:int,i:int,other:bigint>>>")), first(nested), block)["made"])


def running(lengths: Column) -> Column:
    """Sums of what stands before each element of an array; in blocks, as appending to a long array copies it."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["out"], acc["s"]).alias("out")))

    within = F.transform(blocks, sums)
    offsets = sums(F.transform(within, lambda x: x["s"]))["out"]
    return F.flatten(F.zip_with(within, offsets, lambda x, o: F.transform(x["out"], lambda v: v + o)))


def places(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of pattern, leftmost and not overlapping, and where they start."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.transform(F.zip_with(between, hits, lambda p, h: F.length(p) + F.length(h)), lambda n: F.coalesce(n, F.lit(0)).cast("long"))
    return hits, F.zip_with(running(lengths), between, lambda s, p: s + F.length(p))


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of pattern, leftmost and not overlapping, whose group has least characters or more: structs (start, rank, end, kind, part)."""
    hits, starts = places(text, pattern)
    made = F.zip_with(F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("s"), F.length(h).alias("n"))), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.struct(
        x["s"].cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["s"] + x["n"]).cast("long").alias("end"), F.lit(kind).alias("kind"), F.length(g).alias("size"), g.alias("part")))
    kept = F.filter(made, lambda x: x["size"] >= least)
    may = text.rlike(NEEDS[kind]) & text.rlike(pattern) if kind in NEEDS else text.rlike(pattern)
    return F.when(may, F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["part"].alias("part")))).otherwise(F.array().cast(SPANS))


def event(at: Column, order: int, side: int, i: Column, other: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), F.lit(order).alias("order"), F.lit(side).alias("side"), i.cast("int").alias("i"), other.cast("long").alias("other"))


def apart_from(of: Column, others: Column) -> Column:
    """The spans of the first array, in order, that none of the others overlaps: those that begin before its end all end before its start."""
    of = F.array_sort(of)
    events = F.concat(F.transform(others, lambda y: event(y["start"], 1, 0, F.lit(0), y["end"])), F.transform(of, lambda x, i: event(x["end"], 0, 1, i, x["start"])))
    state = {"end": ("bigint", lambda acc, e: F.when(e["order"] == 1, F.greatest(acc["end"], e["other"])).otherwise(acc["end"]))}
    free = swept(F.array_sort(events), state, lambda acc, e: F.when(e["order"] == 0, F.struct(e["i"].alias("i"), (acc["end"].isNull() | (acc["end"] <= e["other"])).alias("ok"))), "struct<i:int,ok:boolean>")
    return F.filter(F.zip_with(of, F.array_sort(free), lambda x, f: F.when(f["ok"], x)), lambda x: x.isNotNull())


def beside(weak: Column, sides: list[Column], blanks: Column, reach: int) -> Column:
    """For each span of weak, in its order, and each side (an array of spans): is one of the side's in scope of it, not overlapping it."""
    kind = "struct<i:int," + ",".join(f"s{k}:boolean" for k in range(len(sides))) + ">"

    def one_way(far: Callable[[Column], Column], near: Callable[[Column], Column], sign: int) -> Column:
        # far: the edge of a part that a candidate meets first, near: the candidate's edge towards it.
        part = lambda k: F.transform(sides[k], lambda y: event(sign * far(y), 0, k, F.lit(0), F.lit(0)))
        parts = [part(k) for k in range(len(sides))]
        events = F.concat(*parts, F.transform(blanks, lambda b: event(sign * b, 1, 0, F.lit(0), F.lit(0))), F.transform(weak, lambda x, i: event(sign * near(x), 2, 0, i, F.lit(0))))
        carry = lambda k: lambda acc, e: F.when((e["order"] == 0) & (e["side"] == k), e["at"]).when(e["order"] != 1, acc[f"s{k}"])
        state = {f"s{k}": ("bigint", carry(k)) for k in range(len(sides))}
        seen = lambda acc, e: F.when(e["order"] == 2, F.struct(e["i"].alias("i"), *[F.coalesce(e["at"] - acc[f"s{k}"] <= reach, F.lit(False)).alias(f"s{k}") for k in range(len(sides))]))
        return F.array_sort(swept(F.array_sort(events), state, seen, kind))

    before = one_way(lambda y: y["end"], lambda x: x["start"], 1)
    after = one_way(lambda y: y["start"], lambda x: x["end"], -1)
    return F.zip_with(before, after, lambda a, b: F.struct(*[(a[f"s{k}"] | b[f"s{k}"]).alias(f"s{k}") for k in range(len(sides))]))


def scan(docs: DataFrame, text: str = "text", name: str = "found", reach: int = REACH) -> DataFrame:
    """docs with the column name: the array of structs (start, rank, end, kind, part), sorted by start, then kind.

    Positions are code points, end exclusive; part is the value alone. Null and empty texts have no findings; equal rows have equal
    findings, and no rows give none. A weak key counts only outside the certain findings and endpoints and with capitals, small
    letters and digits in it. An identifier needs a secret (assign, hex, key) in its scope, a key an identifier (or access), an
    endpoint both. Columns of docs may have any names; one called name gets `_source` appended.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names)
    body = F.coalesce(F.col(names[docs.columns.index(text)]).cast("string"), F.lit(""))
    of = lambda kind: spans(body, kind, *(BASE | WEAK)[kind])
    none = F.array().cast(SPANS)
    out = out.withColumns({f"__{k}": of(k) for k in [*BASE, "identifier"]})
    # A key is 20 or more characters that no other kind has; an endpoint matters only beside both other parts.
    mixed = F.filter(of("key"), lambda x: x["part"].rlike("[0-9]") & x["part"].rlike("[A-Z]") & x["part"].rlike("[a-z]"))
    out = out.withColumn("__key", mixed)
    col = lambda kind: F.col(f"__{kind}")
    sides = (F.size("__key") > 0) | ((F.size("__identifier") + F.size("__access") > 0) & (F.size("__assign") + F.size("__hex") > 0))
    out = out.withColumn("__endpoint", F.when(sides, of("endpoint")).otherwise(none)).withColumn("__certain", F.concat(*[col(k) for k in BASE]))
    out = out.withColumn("__key", F.when(F.size("__key") > 0, apart_from(col("key"), F.concat(col("certain"), col("endpoint")))).otherwise(none))
    secrets, identifiers = F.concat(col("assign"), col("hex"), col("key")), F.concat(col("access"), col("identifier"))
    out = out.withColumns({"__secrets": secrets, "__identifiers": identifiers, "__weak": F.array_sort(F.concat(*[col(k) for k in WEAK]))})
    may = (F.size("__weak") > 0) & (F.size("__secrets") > 0) & (F.size("__identifiers") > 0)
    blanks = F.when(body.rlike(BLANK_LINE), places(body, BLANK_LINE)[1])
    blanks = F.filter(F.coalesce(F.slice(blanks, 1, F.size(blanks) - 1), F.array().cast("array<bigint>")), lambda x: x.isNotNull())
    near = beside(F.col("__weak"), [F.col("__secrets"), F.col("__identifiers")], blanks, reach)
    wanted = lambda x, n: F.when(x["kind"] == "identifier", n["s0"]).when(x["kind"] == "key", n["s1"]).otherwise(n["s0"] & n["s1"])
    linked = F.filter(F.zip_with("__weak", near, lambda x, n: F.when(wanted(x, n), x)), lambda x: x.isNotNull())
    found = F.array_sort(F.concat(F.col("__certain"), F.when(may, linked).otherwise(none)))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept_names(docs.columns, [name]))], found.alias(name))


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every finding in text replaced by mask, overlapping ones by one. Columns and rows otherwise stay; null and empty texts stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = names[docs.columns.index(text)]
    found = scan(docs.toDF(*names), own, "__found")
    body = F.col(own).cast("string")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, x: Column) -> Column:
        fresh = F.array(F.substring(body, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(F.col("__found"), start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    masked = F.when(F.size("__found") > 0, whole).otherwise(body)
    return found.select(*[(masked if n == own else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
