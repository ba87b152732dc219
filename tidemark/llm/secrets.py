"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Base: the leftmost non-overlapping matches of three patterns, less those that are too short.
Places come from the pieces between matches: a match starts after all pieces and matches
before it, a running sum per text and kind.

Method: every candidate value (the assigned value, an access id, a hex run, and any run of
key characters with digits and both cases) is hashed. Distinct (hash, repository, owner)
rows are formed map-side, then counted: a value of SHARED_OWNERS owners or more, or of
SHARED_REPOSITORIES repositories or more whoever owns them, is a widely copied example; a
rarer one with many different characters looks live, and its span is added as kind `live`.
Base spans always stay.

Defined cases: null and empty texts have no spans; null owner and repository are '' ; rows
that repeat are scanned one by one; spans that begin together come in the order of KINDS;
texts of any length are scanned whole; other columns, whatever their names, are left out; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage, whole_text



def _either_case(word: str) -> str:
    """The word with its ASCII letters in either case, and no other letter that folds to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base patterns. A longer least length stands in the pattern where that is the same.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = rf"""(?:{"|".join(map(_either_case, NAMES))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Candidates of the method alone.
BLOB = r"[A-Za-z0-9+/_-]{20,}"
BLOB_NEEDS = (r"[0-9]", r"[a-z]", r"[A-Z]")

KINDS = ("assign", "access", "hex", "live")
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 4
LIVE_CHARACTERS = 8
LIVE_LENGTH = 16


def _found(kind: str, matches: Column, values: Column, pieces: Column) -> Column:
    """array<struct<kind, i, before, length, value, value_length>>, one for each match."""
    lengths = F.transform(pieces, F.char_length)
    return F.transform(
        F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(lengths, 1, F.size(matches)).alias("b")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["b"].cast("long").alias("before"), F.char_length(x["m"]).cast("long").alias("length"),
            x["v"].alias("value"), F.char_length(x["v"]).cast("long").alias("value_length"),
        ),
    )


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row per match, with its place: (uid, doc_id, owner, repository, kind, start, stop,
    value_start, value_hash, looks_live); a text without any has one row of null kind."""
    own = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", whole_text().alias("text"), own(owner).alias("owner"), own(repository).alias("repository"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "blob": BLOB}
    matched = rows.select("*", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()))
    matched = matched.withColumn("assigned", F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).otherwise(F.col("assign")))
    none = F.array().cast("array<string>")
    cut = matched.select("uid", "doc_id", "owner", "repository", "assigned", *patterns, *(F.when(F.size(k) > 0, F.split("text", p, -1)).otherwise(none).alias(f"{k}_cut") for k, p in patterns.items()))
    every = F.concat(*(_found(k, F.col(k), F.col("assigned" if k == "assign" else k), F.col(f"{k}_cut")) for k in patterns))
    one = stage(cut.select("uid", "doc_id", "owner", "repository", F.explode_outer(every).alias("f")).select("uid", "doc_id", "owner", "repository", "f.*"), "secret-matches")
    before = Window.partitionBy("uid", "kind").orderBy("i")
    stop = F.sum(F.col("before") + F.col("length")).over(before)
    placed = one.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("length")).withColumn("value_start", F.col("stop") - F.col("value_length"))
    wanted = (
        F.col("kind").isNull() | F.col("kind").isin("access", "hex") | ((F.col("kind") == "assign") & (F.col("value_length") >= ASSIGN_LEAST))
        | ((F.col("kind") == "blob") & F.col("value").rlike(BLOB_NEEDS[0]) & F.col("value").rlike(BLOB_NEEDS[1]) & F.col("value").rlike(BLOB_NEEDS[2]))
    )
    looks_live = (F.col("value_length") >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS)
    return placed.where(wanted).select("uid", "doc_id", "owner", "repository", "kind", "start", "stop", "value_start", F.xxhash64("value").alias("value_hash"), looks_live.alias("looks_live")), one


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories): exact counts, formed from distinct rows."""
    by_owner = found.where("kind is not null").select("value_hash", "owner", "repository").distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """What query op1 returns, with n_live and n_shared, values that look live and base spans
    whose value is a widely copied example, and max_owners and max_repositories, the greatest
    counts of the text's values."""
    found, matches = candidates(docs, owner, repository)
    found = stage(found, "secret-candidates")
    # written, so that the join has no aggregation in its stage and a hot value can be split
    known = found.where("kind is not null").join(stage(ownership(found), "secret-owners"), "value_hash")
    known = known.withColumn("shared", (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_repositories") >= SHARED_REPOSITORIES))
    base = known.where("kind <> 'blob'").select("uid", "start", "stop", "kind", F.col("shared").cast("int").alias("shared"), "n_owners", "n_repositories")
    live = known.where("looks_live and not shared").groupBy("uid", F.col("value_start").alias("start"), "stop").agg(F.max("n_owners").alias("n_owners"), F.max("n_repositories").alias("n_repositories"))
    live = live.select("uid", "start", "stop", F.lit("live").alias("kind"), F.lit(0).alias("shared"), "n_owners", "n_repositories")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    of_text = base.unionByName(live).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind"))).alias("all"), F.sum("shared").alias("n_shared"), F.max("n_owners").alias("max_owners"), F.max("n_repositories").alias("max_repositories"))
    texts = matches.select("uid", "doc_id").distinct().join(of_text, "uid", "left")
    empty = F.array().cast("array<struct<start: long, rank: long, stop: long, kind: string>>")
    texts = texts.withColumn("all", F.coalesce("all", empty))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    number = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    only_base = F.filter("all", lambda s: s["kind"] != "live")
    return texts.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
        number("live").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"), F.coalesce("max_repositories", F.lit(0)).cast("long").alias("max_repositories"),
    )


def _sql_kind(kind: str, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT uid, owner, repository, '{kind}' AS kind, string_split_regex(text, '{quoted}') AS pieces,
       regexp_extract_all(text, '{quoted}', 0) AS ms, regexp_extract_all(text, '{quoted}', {group}) AS vs FROM d"""


_RUN = "SELECT uid, owner, repository, kind, vs[i] AS value, list_sum([length(x) FOR x IN pieces[1:i]]) + list_sum([length(x) FOR x IN ms[1:i]]) AS stop, length(ms[i]) AS size FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)"
#: The same result in DuckDB, for owner = source and repository = source/lang.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source || '/' || lang, '') AS repository FROM documents),
m AS ({" UNION ALL ".join(_sql_kind(*x) for x in (("assign", ASSIGN, 1), ("access", ACCESS, 0), ("hex", HEX, 0), ("blob", BLOB, 0)))}),
f AS ({_RUN}),
c AS (SELECT *, stop - size AS start, stop - length(value) AS value_start, length(value) >= {LIVE_LENGTH} AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS looks_live FROM f
      WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(value) >= {ASSIGN_LEAST}
         OR kind = 'blob' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')),
o AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repository)) AS n_repositories FROM c GROUP BY value),
k AS (SELECT c.*, n_owners, n_repositories, n_owners >= {SHARED_OWNERS} OR n_repositories >= {SHARED_REPOSITORIES} AS shared FROM c JOIN o USING (value)),
s AS (SELECT uid, start, stop, kind, CAST(shared AS BIGINT) AS shared, n_owners, n_repositories FROM k WHERE kind <> 'blob'
      UNION ALL SELECT uid, value_start, stop, 'live', 0, max(n_owners), max(n_repositories) FROM k WHERE looks_live AND NOT shared GROUP BY 1, 2, 3),
r AS (SELECT *, list_position(['assign', 'access', 'hex', 'live'], kind) AS rank, kind || ':' || start || ':' || stop AS span FROM s),
t AS (SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live,
      string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'live') AS base, string_agg(span, ',' ORDER BY start, rank) AS spans, sum(shared) AS n_shared, max(n_owners) AS owners, max(n_repositories) AS repositories FROM r GROUP BY uid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared,
       CAST(coalesce(owners, 0) AS BIGINT) AS max_owners, CAST(coalesce(repositories, 0) AS BIGINT) AS max_repositories
FROM d LEFT JOIN t USING (uid)
"""
