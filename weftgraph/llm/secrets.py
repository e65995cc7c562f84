"""Secret scan by corpus-wide ownership frequency. DataFrame functions only.

A candidate is a match of one of three fixed patterns. The hash of its secret value is counted over the corpus: in how many
distinct repositories and for how many distinct owners it occurs. A value that ``min_owners`` owners hold, or that lies in
``min_repos`` repositories of however few, is a widely copied example. Any other is owner-specific, and if it also looks random, by
the entropy of its characters, it is reported once more, as a span of kind ``live`` over the value alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import hot_join, materialize, plain

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The two below ask for the least length in the pattern: a run that is too short holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "live")
PATTERNS = (ASSIGN, ACCESS, HEX)
MIN_VALUE = 8
#: From how many owners, or repositories, a value counts as copied.
MIN_OWNERS, MIN_REPOS = 3, 25
#: Bits a character from which a value looks random, by kind: words lie below, random letters and digits of these lengths above.
MIN_ENTROPY = (2.95, 2.95, 2.95)
#: A row without any of these holds no candidate.
ANY = r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

SPAN = "array<struct<start:int,kind:int,end:int,vstart:int,value:string>>"


def _sum(items: Column, n: Column) -> Column:
    return F.aggregate(F.slice(items, F.lit(1), n), F.lit(0), lambda a, x: a + x)


def _span(k: int) -> Callable[[Column, Column], Column]:
    def make(match: Column, i: Column) -> Column:
        start = _sum(F.col(f"_s{k}n"), i + 1) + _sum(F.col(f"_m{k}n"), i)
        end = start + F.length(match)
        value = F.get(F.col("_v0"), i) if k == 0 else match
        return F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"), (end - F.length(value)).alias("vstart"), value.alias("value"))

    return make


def candidate_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the base spans of ``text`` in code points (end exclusive), with where the secret value starts and the value.

    ``text`` must not be null. Regex functions give matches and what lies between them; summed lengths give positions.
    """
    kept = df.columns
    hit = F.col(text).rlike(ANY)
    none = F.array().cast("array<string>")
    step = df.withColumn("_hit", hit)
    for k, pattern in enumerate(PATTERNS):
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        step = step.withColumn(f"_m{k}", F.when(F.col("_hit"), found).otherwise(none))
    for k, pattern in enumerate(PATTERNS):
        some = F.size(f"_m{k}") > 0
        step = step.withColumn(f"_s{k}", F.when(some, F.split(F.col(text), pattern, -1)).otherwise(none))
    values = F.regexp_extract_all(F.col(text), F.lit(ASSIGN), F.lit(2))
    step = step.withColumn("_v0", F.when(F.size("_m0") > 0, values).otherwise(none))
    sized = [F.transform(c, F.length).alias(f"{c}n") for k in range(len(PATTERNS)) for c in (f"_m{k}", f"_s{k}")]
    step = step.select("*", *sized)
    parts = [F.filter(F.transform(F.col(f"_m{k}"), _span(k)), lambda s: F.length(s["value"]) >= MIN_VALUE) for k in range(len(PATTERNS))]
    found = F.array_sort(F.concat(*parts))
    return step.withColumn(out, F.when(F.col("_hit"), found).otherwise(F.array().cast(SPAN))).select(*kept, out)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def ownership(values: DataFrame) -> DataFrame:
    """By ``hash``: distinct ``owners`` and ``repos``, and ``n`` rows. ``values`` has hash, owner, repo; a repository is one of its
    owner's. Each level combines before it is shuffled, so a value in a third of all rows is no large task."""
    each = values.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    pairs = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def entropy(value: Column) -> Column:
    """Bits a character, from how often each character occurs in the value."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def random_looking(value: Column, kind: Column) -> Column:
    """Whether a value's entropy reaches its kind's least one."""
    return entropy(value) >= F.get(F.array(*[F.lit(x) for x in MIN_ENTROPY]), kind)


def _hashed(found: str) -> Column:
    """Spans with their value's hash and whether it looks random, in place of the value."""
    return F.transform(found, lambda s: s.withField("hash", F.sha2(s["value"], 256)).withField("random", random_looking(s["value"], s["kind"])).dropFields("value"))


def _judged(each: DataFrame, min_owners: int, min_repos: int) -> DataFrame:
    """``each`` (.., hash, owner, repo) with ``owners``, ``repos`` and ``shared``."""
    owners = materialize(ownership(each.select("hash", "owner", "repo")), "owners")
    shared = (F.col("owners") >= min_owners) | (F.col("repos") >= min_repos)
    return hot_join(each.drop("owner", "repo"), owners.drop("n").withColumn("shared", shared), "hash", owners.select("hash", "n"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """Find secrets in every row of ``df``, and tell copied examples from owner-specific ones.

    Returns a row for each row of ``df``: the id, ``n_assign``, ``n_access``, ``n_hex`` (long), ``base_sha256``, ``spans``,
    ``n_live`` (owner-specific values that look random), ``n_shared`` (values of ``min_owners`` owners or ``min_repos``
    repositories), ``max_owners`` and ``max_repos``. ``repo_col`` defaults to the id: every document counts as a repository of its
    owner.

    Null text counts as empty. Null owners are one owner. Null ids and repeated rows are kept, each with a result of its own.
    Texts without a match have zero counts, the SHA-256 of nothing and empty ``spans``. An empty table gives an empty result.
    Other columns are not read, so their names cannot clash.
    """
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = candidate_spans(rows, "text", "found").drop("text").withColumn("row", F.monotonically_increasing_id())
    found = materialize(found.withColumn("found", _hashed("found")), "secrets")
    each = found.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s"))
    judged = _judged(each.select("row", "owner", "repo", "s", F.col("s.hash").alias("hash")), min_owners, min_repos)
    live = F.col("s.random") & ~F.col("shared")
    added = F.struct(F.col("s.vstart").alias("start"), F.lit(KINDS.index("live")).alias("kind"), F.col("s.end").alias("end"))
    by_row = judged.groupBy("row").agg(
        F.collect_set(F.when(live, added)).alias("added"),
        F.countDistinct(F.when(live, F.col("hash"))).alias("n_live"),
        F.countDistinct(F.when(F.col("shared"), F.col("hash"))).alias("n_shared"),
        F.max("owners").alias("max_owners"),
        F.max("repos").alias("max_repos"),
    )
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = found.select("row", F.col("id"), base.alias("base")).join(by_row, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", F.coalesce("added", none)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"),
        F.coalesce("max_repos", F.lit(0)).cast("long").alias("max_repos"),
    )


def mask_secrets(df: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """``df`` with every secret replaced: ``[SECRET]`` where its value is owner-specific, ``[EXAMPLE]`` where it is widely copied.

    Texts are scanned once. Rows without a candidate pass as they are, and no row is dropped: repeated rows each stay and are masked
    alike, and rows with a null id count as one repository of their owner. Where spans overlap, what they cover together is replaced
    once, as a secret if any of them is one. Columns and their order stay; null texts stay null.
    """
    row = F.struct(*[F.col(plain(c)).alias(c) for c in df.columns if c != text_col])
    rows = df.select(
        (row if len(df.columns) > 1 else F.lit(None).cast("string")).alias("rest"),
        F.coalesce(F.col(plain(owner_col)).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(plain(repo_col)).cast("string"), F.lit("")).alias("repo"),
        F.col(plain(text_col)).alias("text"),
        F.coalesce(F.col(plain(text_col)), F.lit("")).alias("whole"),
    )
    spans = candidate_spans(rows, "whole", "found").drop("whole").withColumn("row", F.monotonically_increasing_id())
    found = materialize(spans.withColumn("found", F.transform("found", lambda s: s.withField("hash", F.sha2(s["value"], 256)).dropFields("value"))), "masks")
    each = found.filter(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("s"))
    judged = _judged(each.select("row", "owner", "repo", "s", F.col("s.hash").alias("hash")), min_owners, min_repos)
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), (~F.col("shared")).alias("own")))).alias("spans"))
    text = F.col("text")
    empty = F.array().cast("array<struct<start:int,end:int,own:boolean>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), (last["own"] | s["own"]).alias("own"))
        apart = F.concat(acc, F.array(s))
        return F.when(F.size(acc) == 0, apart).when(s["start"] < last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(apart)

    step = found.filter(F.size("found") > 0).select("rest", "text", "row").join(by_row, "row").withColumn("merged", F.aggregate("spans", empty, merge))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    put = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.when(s["own"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))).alias("out"))
    masked = F.aggregate("merged", start, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    def shaped(rows: DataFrame, text: Column) -> DataFrame:
        return rows.select(*[text.alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns])

    return shaped(found.filter(F.size("found") == 0), text).unionByName(shaped(step, masked))
