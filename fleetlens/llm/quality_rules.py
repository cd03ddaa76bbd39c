"""Quality rules: counts within a document, and how often its lines occur across the documents of its host.

Lines are normalised (lower case, digits as 0, white space as one blank) and hashed. A line that more than
``least_documents`` documents of one host hold, and more than ``share`` percent of that host's documents, is
boilerplate and is removed; a document that loses more than ``depleted`` percent of its words that way is rejected.
:func:`quality_report` gives counts and verdicts, :func:`keep_good_documents` the rows that pass, with the lines that
remain. Documents of a host with equal texts are one document in these counts: copies are for deduplication to judge.

Only DataFrame functions run. The text is scanned once; what the counts need is one small row per document in a staged
table. Counts combine before the shuffle, and rows meet them in plain joins, which Spark splits where a line is hot.

Defined cases: a null text is an empty one (no words, base_failed); a null host is a host of its own; repeated rows
each get a row back, with the same verdict; an empty table gives an empty one; other columns are not looked at, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE, SPACES, no_text, stage, words

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
LEAST_DOCUMENTS, SHARE, DEPLETED = 30, 2, 70

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE, " "), "[0-9]", "0"), F.lit(SPACES))


def with_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the five counts of :data:`BASE`, ``base_failed`` and the hashed ``lines``.

    Windows of eight words are hashed to 64 bits. Only where two hashes of a text are equal are they sorted with their
    positions; a run of repeated windows then covers the words from its first to its last position + 8.
    """
    has_word = lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0
    base = df.select(*keep, no_text(text).alias("_t"))
    base = base.select(*keep, "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), has_word).alias("_l"))
    base = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "_l",
            lambda line: F.struct(
                F.xxhash64(normalised(line)).alias("line"), F.size(words(line)).cast("long").alias("n")
            ),
        ).alias("lines"),
        F.when(
            F.size("_w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    kept = [*keep, *BASE[:-1], "lines"]
    placed = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    base = base.select(
        *kept, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed).alias("_s")
    )
    same = lambda x, i, step: F.coalesce(F.get("_s", i + step)["g"] == x["g"], F.lit(False))
    repeated = F.filter("_s", lambda x, i: same(x, i, -1) | same(x, i, 1))
    base = base.select(*kept, F.array_sort(F.transform(repeated, lambda x: x["i"])).alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + (p + WINDOW - F.greatest(a["end"], p))).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    base = base.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def lost_lines(
    counted: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: int = SHARE, depleted: int = DEPLETED
) -> DataFrame:
    """``host, same, lost, depleted`` of the texts that lose lines: the hashes of those, and whether more than
    ``depleted`` percent of the words go with them.

    ``counted`` has host, same (equal for equal texts) and lines; it is read twice, so it should be a stored table.
    Words are summed over all copies of a text, flagged and in all, so the share is that of one copy.
    """
    rows = counted.select("host", "same", F.explode("lines").alias("x")).select("host", "same", "x.line", "x.n")
    held = stage(rows.groupBy("host", "same", "line").agg(F.sum("n").alias("n")), "lines-of-documents")
    per_host = counted.select("host", "same").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    per_line = held.groupBy("host", "line").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") > least_documents)
    per_host = stage(per_host, "documents-of-hosts")
    frequent = (
        per_line.join(per_host, "host")
        .filter(100 * F.col("n_documents") > share * F.col("documents"))
        .select("host", "line", F.lit(True).alias("frequent"))
    )
    frequent = stage(frequent, "frequent-lines")
    lost = held.join(frequent, ["host", "line"], "left").groupBy("host", "same").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("frequent"), F.col("n")).otherwise(0)).alias("removed"),
        F.collect_list(F.when(F.col("frequent"), F.col("line"))).alias("lost"),
    )
    return lost.filter("removed > 0").select("host", "same", "lost", (100 * F.col("removed") > depleted * F.col("all")).alias("depleted"))


def depleted_documents(counted: DataFrame, **limits: int) -> DataFrame:
    """``host, same`` of the documents that lose too many of their words."""
    return lost_lines(counted, **limits).filter("depleted").select("host", "same")


def _keys(text: str, host: str) -> list[Column]:
    return [
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"),
        F.md5(no_text(text).cast("binary")).alias("same"),
    ]


def quality_report(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source",
    least_documents: int = LEAST_DOCUMENTS, share: int = SHARE, depleted: int = DEPLETED,
) -> DataFrame:
    """Per document: its id, the counts of :data:`BASE`, base_failed, kept."""
    counted = stage(with_counts(docs.select(F.col(id).alias("id"), text, *_keys(text, host)), text, ["id", "host", "same"]), "line-counts")
    gone = depleted_documents(counted, least_documents=least_documents, share=share, depleted=depleted)
    gone = stage(gone, "depleted").withColumn("gone", F.lit(True))
    kept = ~F.col("base_failed") & F.col("gone").isNull()
    return counted.join(gone, ["host", "same"], "left").select(F.col("id").alias(id), *BASE, "base_failed", kept.alias("kept"))


def remaining(text: Column, lost: Column) -> Column:
    """The text without its lines whose hashes are in ``lost``."""
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~F.array_contains(lost, F.xxhash64(normalised(line))))
    return F.array_join(kept, "\n")


def keep_good_documents(
    docs: DataFrame, text: str = "text", host: str = "source", n_chars: str | None = "n_chars", **limits: int
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; boilerplate lines are gone from ``text``, and ``n_chars``
    counts anew where some are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("_text"), *_keys(text, host))
    counted = stage(with_counts(rows, "_text", ["host", "same"]), "line-counts")
    failed = counted.filter("base_failed").select("host", "same", F.array().cast("array<bigint>").alias("lost"), F.lit(True))
    verdicts = lost_lines(counted, **limits).union(failed).groupBy("host", "same")
    verdicts = stage(verdicts.agg(F.max("lost").alias("lost"), F.max("depleted").alias("rejected")), "verdicts")
    good = rows.join(verdicts, ["host", "same"], "left").filter(~F.coalesce("rejected", F.lit(False)))
    good = good.withColumn("_new", F.when(F.size("lost") > 0, remaining(F.col("_text"), F.col("lost"))))
    changed = {text: F.col("_new")}
    if n_chars in docs.columns:
        changed[n_chars] = F.length("_new").cast(docs.schema[n_chars].dataType)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return good.select(*(F.coalesce(changed[c], old[c]).alias(c) if c in changed else old[c].alias(c) for c in old))


#: kept_sql gives the verdict from a table ``d`` (doc_id, text, source); also used by the pipeline's twin.
BASE_SQL = r"""
w AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) r(k) GROUP BY 1),
ln AS (SELECT doc_id, source, l FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM w)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY 1),
base AS (SELECT w.doc_id, w.source, md5(t) AS same, len(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dl.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
    FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN dl ON dl.doc_id = w.doc_id),
nl AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS l,
    len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM ln),
hosts AS (SELECT source, count(DISTINCT same) AS n FROM base GROUP BY 1),
freq AS (SELECT nl.source, nl.l FROM nl JOIN base USING (doc_id)
    JOIN hosts h ON h.source IS NOT DISTINCT FROM nl.source
    GROUP BY nl.source, nl.l, h.n HAVING count(DISTINCT same) > 30 AND 100 * count(DISTINCT same) > 2 * h.n),
gone AS (SELECT nl.doc_id FROM nl LEFT JOIN freq f ON f.l = nl.l AND f.source IS NOT DISTINCT FROM nl.source
    GROUP BY 1 HAVING 100 * sum(CASE WHEN f.l IS NOT NULL THEN nl.n ELSE 0 END) > 70 * sum(nl.n)),
verdict AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM base)
"""
SQL = "WITH " + BASE_SQL.replace("{docs}", "documents").strip() + " SELECT * FROM verdict"
