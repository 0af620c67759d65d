"""Secret scans with corpus-wide ownership frequency, by DataFrame operations only.

Spans are found by patterns. The base kinds are assign, access and hex; further kinds are added to them. Offsets are
code points, the end exclusive: they follow from splitting a text at the matches and adding up lengths. Each secret's
hash is then counted over the corpus, by distinct repositories (documents, unless told otherwise) and owners
(sources). A secret that many owners hold in many repositories is a copied example: one repository that several owners
mirror does not make it one, nor do many repositories of one owner. So is one with hardly any different characters. All
others look live. A private key is its whole block, and its secret the body without line breaks; a first line without a
body is no key and never live.

Defined cases: null texts count as empty, and masking leaves them null; a null owner or repository counts as one of its
own; repeated rows count once as a repository, and each gives its own row. A row is told by its id and text: rows with
equal ids, or without an id, and different texts keep their own spans. An empty table gives an empty result. Further
columns are ignored by the scan and kept by the masking, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A private key from its first line to its END line; where none follows, as far as lines of its alphabet go.
PEM_BODY = r"[^-]*+(?:-{1,4}+[^-]++)*+(?=-----END [A-Z ]*PRIVATE KEY-----)"
PEM_REST = r"(?:[\s\\nr]{0,8}[A-Za-z0-9+/=]{16,}+)*+(?:\r?\n[A-Za-z0-9+/]{1,15}={0,2}(?=\r?\n|$))?"
PEM = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----({PEM_BODY}|{PEM_REST})(?:-----END [A-Z ]*PRIVATE KEY-----)?"
#: (kind, pattern, group with the secret, least length of that group, literal or pattern that any match holds).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", ASSIGN, 2, 8, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh[pousr]_"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox[abprs]-"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
    ("pem", PEM, 1, 0, "-----BEGIN "),
]
BASE = 3
#: A secret of fewer different characters is an example.
VARIETY = 5
SPAN = "struct<start:int,no:int,end:int,kind:string,secret:string>"


def found(text: Column, no: int) -> Column:
    """Array of (start, no, end, kind, secret) of one kind's matches, in order."""
    kind, pattern, group, least, hint = KINDS[no]
    pieces, whole, inner = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), inner.alias("inner"))
    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def secret(inner: Column) -> Column:
        return F.regexp_replace(inner, r"\s|\\[nr]", "") if kind == "pem" else inner

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["before"])
        end = begin + F.length(m["whole"])
        span = F.struct(begin.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), secret(m["inner"]).alias("secret"))
        return F.struct(end.alias("at"), F.when(F.length(m["inner"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    hit = text.contains(hint) if not set("[(?\\") & set(hint) else text.rlike(hint)
    return F.when(hit, F.aggregate(zipped, start, step, lambda acc: acc["spans"])).otherwise(empty)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def how_many(no: int) -> Column:
    return F.size(F.filter("found", lambda s: s["no"] == no)).cast("long")


def scan(docs: DataFrame, text: str) -> DataFrame:
    """Adds the sorted array ``found`` of all spans."""
    body = docs.withColumn("read", F.coalesce(text, F.lit("")))
    return body.withColumn("found", F.sort_array(F.concat(*[found(F.col("read"), i) for i in range(len(KINDS))]))).drop("read")


def ownership(spans: DataFrame, owners: int, repositories: int) -> DataFrame:
    """(secret, owner, repository) -> secret, n_repositories, n_owners, example. Each step aggregates before it shuffles."""
    one = spans.select("secret", "owner", "repository").distinct()
    by_owner = one.select("secret", "owner").distinct().groupBy("secret").agg(F.count("*").alias("n_owners"))
    by_repository = one.select("secret", "repository").distinct().groupBy("secret").agg(F.count("*").alias("n_repositories"))
    out = by_owner.join(by_repository, "secret")
    return out.withColumn("example", (F.col("n_owners") >= owners) & (F.col("n_repositories") >= repositories))


def judged(docs: DataFrame, owners: int, repositories: int, owner: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """(scanned, verdicts): (key, body, found) of every row; (key_, body_, live, other), the spans of each key and text."""
    rows = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("read_text"), F.struct(owner).alias("owner"), F.struct(repository).alias("repository"))
    scanned = materialize(scan(rows, "read_text").select("key", body_of("read_text").alias("body"), "owner", "repository", "found"), "scanned")
    some = scanned.where(F.size("found") > 0).select("key", "body", "owner", "repository", F.explode("found").alias("s"))
    each = some.select("key", "body", "owner", "repository", F.sha2("s.secret", 256).alias("secret"), F.struct("s.start", "s.end").alias("place"), (F.size(F.array_distinct(F.split("s.secret", ""))) >= VARIETY).alias("varied"))
    owned = materialize(ownership(each, owners, repositories), "ownership")
    told = each.join(owned, "secret").withColumn("live", ~F.col("example") & F.col("varied"))
    verdicts = told.groupBy(F.col("key").alias("key_"), F.col("body").alias("body_")).agg(F.collect_set(F.when(F.col("live"), F.col("place"))).alias("live"), F.collect_set(F.when(~F.col("live"), F.col("place"))).alias("other"))
    return scanned, verdicts


def body_of(text: str) -> Column:
    """Tells texts of one id, or without an id, apart; equal rows have equal spans anyway."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def scan_secrets(docs: DataFrame, owners: int = 3, repositories: int = 3, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live (their spans)."""
    scanned, verdicts = judged(docs, owners, repositories, owner, repository)
    both = scanned.join(verdicts, F.col("key").eqNullSafe(F.col("key_")) & (F.col("body") == F.col("body_")), "left")
    base = F.filter("found", lambda s: s["no"] < BASE)
    none = F.array().cast("array<struct<start:int,end:int>>")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return both.select(
        F.col("key").alias("doc_id"),
        *[how_many(i).alias(f"n_{KINDS[i][0]}") for i in range(BASE)],
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("found")).alias("spans"),
        size("live").alias("n_live"),
        size("other").alias("n_example"),
        F.sort_array(F.coalesce("live", none)).alias("live"),
    )


def mask_live(docs: DataFrame, mask: str = "[SECRET]", owners: int = 3, repositories: int = 3, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """The documents with live-looking secrets masked and ``n_chars`` of the new text; none is dropped."""
    _, verdicts = judged(docs, owners, repositories, owner, repository)
    verdicts = materialize(verdicts.where(F.size("live") > 0).select("key_", "body_", F.sort_array("live").alias("live_")), "verdict")
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's names cannot clash with ours
    own = dict(zip(docs.columns, names, strict=True))
    text, live = F.col(own["text"]), F.col("live_")
    joined = docs.toDF(*names).join(verdicts.hint("merge"), F.col(own["doc_id"]).eqNullSafe(F.col("key_")) & (body_of(own["text"]) == F.col("body_")), "left")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(live, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    change = live.isNotNull() & text.isNotNull()
    out = joined.withColumn("masked_", F.when(change, masked).otherwise(text))
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(own["n_chars"], F.when(change, F.length("masked_").cast(kind)).otherwise(F.col(own["n_chars"])))
    return out.withColumn(own["text"], F.col("masked_")).select(names).toDF(*docs.columns)
