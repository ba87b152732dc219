"""Line dedup by a fixed-depth log-template tree; DataFrame functions only.

A line's tokens are what single spaces part it into, spaces at its ends aside; a token with
a digit is the variable <*>. Its leaf in the tree is its token count and its LEADING first
tokens. Lines of one leaf whose other tokens differ may be one template with more variable
fields: where a leaf has several wordings and is in MIN_DOCUMENTS texts or more, each wording
gives up the variable fields that such a template may have, one or a tenth of the line's
tokens: those after the leading tokens whose tokens fewest of the leaf's wordings have at
that place. Wordings that are equal at all other places are one template, however many
templates the leaf holds. A template of differing wordings has WORDS constant words or more
after the leading tokens, a word being a token with a letter; a line with a variable and
fewer words than WORDS in all (a number, a table's row of numbers, a page number) is a
template only with its equals.

Two things recur: a template in MIN_DOCUMENTS or more different texts (exact copies count
once), and a line of LONG tokens or more that stands word for word in MIN_LONG or more. Their
lines are dropped, but for the first in the text with the least doc_id. So a dropped line has
an equal that is kept, or one that differs from it in numbers and in a template's variable
fields only. Lines without tokens stay. Kept lines are unchanged, in order.

Distinct (template, text) rows are formed before counting, so a line that a third of all
texts hold is counted map-side. Text itself is shuffled once, to meet its decisions.

Defined cases: null text is empty, has one line, and stays as it is; texts and lines of any
length are read whole; rows that share a doc_id are one document if their texts are equal,
else texts of their own, of which the least hash comes first; of places of most frequent
tokens the first is kept; other columns, whatever their names, are only passed on; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filtered_joins, quoted, scratch, stage, unused, whole_text

LEADING = 3
MIN_DOCUMENTS = 10
#: A line of so many tokens recurs in so many texts, word for word.
LONG, MIN_LONG = 20, 2
#: A template has one variable field more, or one for so many tokens.
VARIABLE_SHARE = 10
WORDS = 2
LETTER = r"\p{L}"
#: WORDS words in a masked line: anchored and without giving back, so in time linear in the line.
ENOUGH = rf"^(?:[^\p{{L}}]*+\p{{L}}[^ ]*+){{{WORDS}}}"
#: From the start of a token only, and without giving back, so in time linear in the text.
VARIABLE = r"(?<![^ \n])[^ 0-9\n]*+[0-9][^ \n]*+"


def _masked(line: str) -> Column:
    # most lines have no digit, which is quicker to tell than to look at each token's start
    return F.when(F.col(line).rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(F.col(line))


def _n_tokens(line: str) -> Column:
    return F.when(F.col(line) == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1)


def _worded(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda x: x.rlike(LETTER))) >= WORDS


def _templates(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(leaf, wording, template) for the wordings that may share a template with others.

    held: (leaf, wording, content, first). Only leaves that can recur and vary are looked at,
    and of each of their wordings one line, which is read again from its text.
    """
    wordings = held.where("leaf is not null").groupBy("leaf", "wording").agg(F.count("*").alias("texts"), F.min(F.struct("first.doc_id", "first.pos", "content")).alias("at"))
    wordings = stage(wordings, "wordings")
    leaves = wordings.groupBy("leaf").agg(F.count("*").alias("variants"), F.sum("texts").alias("texts"))
    leaves = stage(leaves.where((F.col("variants") > 1) & (F.col("texts") >= MIN_DOCUMENTS)).select("leaf"), "leaves")
    wanted = wordings.join(leaves, "leaf").groupBy(F.col("at.doc_id").alias("wanted_id"), F.col("at.content").alias("content")).agg(F.collect_list(F.struct("at.pos", "leaf", "wording")).alias("lines"), F.count("*").alias("n"))
    wanted = stage(wanted, "wanted").where("n > 0")
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("content"), whole_text().alias("text")).join(wanted.hint("merge"), ["content"]).where(F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    rows = rows.select(F.split("text", "\n").alias("all"), F.explode("lines").alias("l")).select("l.leaf", "l.wording", F.trim(F.get("all", F.col("l.pos"))).alias("raw"))
    rows = rows.select("leaf", "wording", F.split(_masked("raw"), " ", -1).alias("tokens"))
    with filtered_joins(docs.sparkSession):  # only texts with a wanted line are shuffled
        variants = stage(rows, "variants").dropDuplicates(["leaf", "wording"])
    kept = (F.size("tokens") - LEADING - F.greatest(F.lit(1), F.floor(F.size("tokens") / VARIABLE_SHARE))).cast("int")
    at = variants.select("leaf", "wording", kept.alias("n_kept"), F.posexplode("tokens").alias("at", "token")).where((F.col("at") >= LEADING) & (F.col("n_kept") >= WORDS))
    at = stage(at, "tokens")
    # a count at each position, formed map-side
    have = stage(at.groupBy("leaf", "at", "token").agg(F.count("*").alias("have")), "counts")
    ranked = at.join(have, ["leaf", "at", "token"]).groupBy("leaf", "wording", "n_kept").agg(F.sort_array(F.collect_list(F.struct((-F.col("have")).alias("rank"), "at", "token"))).alias("all"))
    most = F.slice("all", F.lit(1), F.col("n_kept"))
    ranked = ranked.where(_worded(F.transform(most, lambda x: x["token"])))
    constant = F.sort_array(F.transform(most, lambda x: F.struct(x["at"], x["token"])))
    return ranked.select("leaf", "wording", F.xxhash64(F.lit("template"), F.col("leaf"), constant).alias("template"))


def _lines(docs: DataFrame, alone: DataFrame | None) -> DataFrame:
    """(doc_id, content, pos, leaf, wording, stays): a row per line with tokens, and for a long
    line one more, with null leaf and the hash of its own words."""
    # never empty; the plain explode() would be filtered by its whole expression, split twice
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("content"), F.posexplode_outer(F.split(whole_text(), "\n")).alias("pos", "raw"))
    rows = rows.withColumn("raw", F.trim("raw")).where("raw <> ''").withColumn("line", _masked("raw")).withColumn("n", _n_tokens("raw"))
    # without enough words a line stands in a leaf of its own
    rows = rows.withColumn("own", F.when(F.col("line").contains("<*>") & ~F.col("line").rlike(ENOUGH), F.xxhash64(F.lit("alone"), F.col("raw"))))
    by_template = F.struct(F.coalesce("own", F.xxhash64("n", F.substring_index("line", " ", LEADING))).alias("leaf"), F.coalesce("own", F.xxhash64("line")).alias("wording"))
    by_words = F.struct(F.lit(None).cast("long").alias("leaf"), F.xxhash64(F.lit("words"), F.col("raw")).alias("wording"))
    keys = F.when(F.col("n") >= LONG, F.array(by_template, by_words)).otherwise(F.array(by_template))
    lines = stage(rows.select("doc_id", "content", "pos", F.explode_outer(keys).alias("k")).select("doc_id", "content", "pos", "k.*"), "lines")
    if alone is None:
        return lines.withColumn("stays", F.lit(False))
    told = stage(alone.select("doc_id", "counts").where("doc_id is not null"), "alone")
    joined = stage(lines.join(told.hint("merge"), "doc_id", "left"), "counted-lines")
    return joined.where(F.coalesce("counts", F.lit(True))).select(*lines.columns, F.col("counts").isNotNull().alias("stays"))


def recurring_lines(docs: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """(doc_id, content, dropped): per text with a line to drop, the places of those lines;
    content is the text's hash.

    alone: (doc_id, counts), documents that keep all their lines. Those that count are where
    a recurring line is kept rather than elsewhere; of the others nothing is read.
    """
    with scratch(docs.sparkSession) as keep:
        lines = _lines(docs, alone)
        held = lines.groupBy("leaf", "wording", "content").agg(F.min(F.struct((~F.col("stays")).alias("later"), "doc_id", "content", "pos")).alias("first"))
        held = stage(held, "held")
        templates = stage(_templates(docs, held), "templates")
        named = held.join(templates, ["leaf", "wording"], "left").withColumn("template", F.coalesce("template", F.xxhash64(F.col("leaf").isNull(), "leaf", "wording")))
        by_text = named.groupBy("template", "content").agg(F.min("first").alias("first"), F.max(F.col("leaf").isNull()).alias("by_words"))
        least = F.when(F.col("by_words"), MIN_LONG).otherwise(MIN_DOCUMENTS)
        recurring = by_text.groupBy("template", "by_words").agg(F.count("*").alias("texts"), F.min("first").alias("first")).where(F.col("texts") >= least)
        recurring = stage(recurring.select("template", F.struct("first.doc_id", "first.content", "first.pos").alias("first")), "recurring")
        dropped = stage(named.select("leaf", "wording", "template").distinct().join(recurring, "template").select("wording", F.col("leaf").isNull().alias("words"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "first"), "dropped")
        at = lines.where("not stays").select("doc_id", "content", "pos", "wording", F.col("leaf").isNull().alias("words"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
        with filtered_joins(docs.sparkSession):
            gone = at.join(dropped.where("leaf is not null").hint("merge"), ["words", "leaf", "wording"]).where(~F.struct("doc_id", "content", "pos").eqNullSafe(F.col("first")))
            return keep(gone.groupBy("doc_id", "content").agg(F.collect_set("pos").alias("dropped")), "dropped-lines")


def _decided(docs: DataFrame, alone: DataFrame | None = None) -> tuple[DataFrame, Column, Column]:
    """(docs with a further column, that column: places of dropped lines or null for none, the
    shortened text); the columns of docs are untouched."""
    of_id, of_content, gone = unused(docs, "dropped_of", "dropped_content", "dropped")
    found = recurring_lines(docs, alone).select(F.col("doc_id").alias(of_id), F.col("content").alias(of_content), F.col("dropped").alias(gone))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(whole_text()) == F.col(of_content))


    def shortened(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    # the lines as a lambda's argument: split once, not again for each line that is taken from them
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n")), shortened), F.lit(0)))
    return docs.join(found.hint("merge"), same, "left"), F.col(gone), text


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), a row per row of docs."""
    own, dropped, text = _decided(docs.select("doc_id", "text"))
    n = F.when(dropped.isNull(), 0).otherwise(F.size(dropped))
    return own.select("doc_id", text.alias("text"), F.size(F.split(whole_text(), "\n")).alias("n_lines"), n.alias("n_dropped"))


def deduplicated(docs: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """docs with their texts shortened; n_chars, where there is one, follows the text. A document
    that has nothing of its own, none but dropped and blank lines, goes.

    alone: (doc_id, counts), documents to leave as they are; see recurring_lines.
    """
    own, dropped, text = _decided(docs, alone)
    short, = unused(own, "short_text")
    own = own.withColumn(short, text).where(dropped.isNull() | F.col(short).rlike(r"[^ \n]"))
    changed = {"text": F.col(short)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(dropped.isNull(), F.col("n_chars")).otherwise(F.char_length(short).cast(docs.schema["n_chars"].dataType))
    return own.select(*(changed[c].alias(c) if c in changed else of for c, of in zip(docs.columns, quoted(docs), strict=True)))
