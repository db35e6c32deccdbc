"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import contamination, encoding, subjects
from kinweave.llm.addresses import location_links, same_locations
from kinweave.llm.copies import formatting_copies
from kinweave.llm.distinctive import PRIOR_WORDS, most_distinctive, term_scores
from kinweave.llm.frequency import frequencies
from kinweave.llm.grouping import link_groups
from kinweave.llm.names import spelling_variants, variant_links

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_FORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[.,]', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WORDS = "list_filter(string_split(" + _FORM + ", ' '), lambda x: x <> '')"
_FIELDS = ("BorrowerName", "BorrowerAddress")


def _present(c: str) -> str:
    return f"{c} IS NOT NULL AND {c} NOT IN ('', 'nan', 'None')"


_CELLS = " UNION ALL ".join(f"SELECT row_idx, '{f}' AS field, {_WORDS.format(c=f)} AS w FROM scan WHERE {_present(f)}" for f in _FIELDS)
_TERMS = f"""cells AS ({_CELLS}), tf AS (SELECT row_idx, field, len(w) AS n, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM cells) GROUP BY ALL),
    st AS (SELECT field, term, sum(tf) AS c, count(*) AS df FROM tf GROUP BY ALL)"""


@query(f"""WITH {_TERMS}, x AS (SELECT row_idx, field, term, df, min(df) OVER w AS least, count(*) OVER w AS n FROM tf JOIN st USING (field, term) WINDOW w AS (PARTITION BY row_idx, field)),
    y AS (SELECT *, count(*) FILTER (df = least) OVER (PARTITION BY row_idx, field) AS ties FROM x)
    SELECT row_idx, field, term FROM y WHERE n >= 2 AND df = least AND ties = 1 AND df BETWEEN 2 AND 5""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Words are counted once a record against the collection's own counts as prior; z then falls strictly as df rises."""
    scores = term_scores(table(spark, folder, "scan"), "row_idx", _FIELDS, prior=None, by_record=True)
    return most_distinctive(scores, "row_idx").where("n_terms >= 2 AND df BETWEEN 2 AND 5").select("row_idx", "field", "term")


_ALPHA = f"({PRIOR_WORDS} * c / t)"


@query(f"""WITH {_TERMS}, tot AS (SELECT field, sum(c) AS t FROM st GROUP BY 1), x AS (SELECT * FROM tf JOIN st USING (field, term) JOIN tot USING (field))
    SELECT row_idx, field, term, df, round((ln((tf + {_ALPHA}) / (n + {PRIOR_WORDS} - tf - {_ALPHA})) - ln((c - tf + {_ALPHA}) / (t - n + {PRIOR_WORDS} - (c - tf) - {_ALPHA})))
        / sqrt(1 / (tf + {_ALPHA}) + 1 / (c - tf + {_ALPHA})), 6) AS z FROM x""")
def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The z-score of every term of every record."""
    return term_scores(table(spark, folder, "scan"), "row_idx", _FIELDS).select("row_idx", "field", "term", "df", F.round("z", 6).alias("z"))


_MATCH = "idx1 <> idx2 AND (coalesce(BorrowerName_similarity, 0) >= 0.7 OR coalesce(BorrowerAddress_similarity, 0) >= 0.8)"


@query(f"""WITH RECURSIVE m AS (SELECT idx1 AS a, idx2 AS b FROM evidence WHERE {_MATCH} UNION SELECT idx2, idx1 FROM evidence WHERE {_MATCH}),
    reach AS (SELECT a AS node, a AS other FROM m UNION SELECT reach.node, m.b FROM reach JOIN m ON reach.other = m.a)
    SELECT node AS row_idx, min(other) AS cluster_label FROM reach GROUP BY 1""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    score = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    match = (F.col("idx1") != F.col("idx2")) & ((score("BorrowerName_similarity") >= 0.7) | (score("BorrowerAddress_similarity") >= 0.8))
    return link_groups(table(spark, folder, "evidence").where(match)).select(F.col("node").alias("row_idx"), F.col("group_id").alias("cluster_label"))


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "scan"), "row_idx", "BorrowerName", "BorrowerAddress")


@query()
def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every named record with its class of equal normal forms and its number of variant records."""
    return variant_links(table(spark, folder, "scan"), "row_idx", "BorrowerName", "BorrowerAddress")


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_locations(table(spark, folder, "scan"), "row_idx", "BorrowerAddress")


@query()
def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with an address, its class of equal normal forms and its number of records of the same location."""
    return location_links(table(spark, folder, "scan"), "row_idx", "BorrowerAddress")


_BAGS = f"SELECT row_idx, list_sort(list_concat(coalesce({_WORDS.format(c='BorrowerName')}, []), coalesce({_WORDS.format(c='BorrowerAddress')}, []))) AS bag FROM scan"


@query(f"SELECT idx1, row_idx AS idx2 FROM (SELECT row_idx, min(row_idx) OVER (PARTITION BY bag) AS idx1 FROM ({_BAGS})) WHERE idx1 <> row_idx")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    copies = formatting_copies(table(spark, folder, "scan"), "row_idx", _FIELDS)
    return copies.where(F.col("row_idx") != F.col("first_id")).select(F.col("first_id").alias("idx1"), F.col("row_idx").alias("idx2"))


@query(f"SELECT min(row_idx) AS row_idx, count(*) AS copies FROM ({_BAGS}) GROUP BY bag")
def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record of each group of copies, with their number."""
    return formatting_copies(table(spark, folder, "scan"), "row_idx", _FIELDS).where("row_idx = first_id").select("row_idx", "copies")


_RECORDS = f"SELECT DISTINCT id, BorrowerName FROM companycleaner WHERE {_present('BorrowerName')}"
_FREQUENT = """SELECT term, sum(times)::BIGINT AS occurrences, count(DISTINCT id) AS records FROM ({terms}) GROUP BY 1"""
_WORD_ROWS = f"SELECT id, term, count(*) AS times FROM (SELECT id, unnest({_WORDS.format(c='BorrowerName')}) AS term FROM ({_RECORDS})) GROUP BY 1, 2"
_MARK = f"CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.05 * (SELECT count(DISTINCT id) FROM ({_RECORDS})) THEN 'common' END"


@query(f"SELECT term, mark FROM (SELECT term, {_MARK} AS mark FROM ({_FREQUENT.format(terms=_WORD_ROWS)})) WHERE mark IS NOT NULL")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies(table(spark, folder, "companycleaner"), "id", "BorrowerName").where("mark IS NOT NULL").select("term", "mark")


@query(f"SELECT term, occurrences, records, {_MARK} AS mark FROM ({_FREQUENT.format(terms=_WORD_ROWS)})")
def p7_words(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies(table(spark, folder, "companycleaner"), "id", "BorrowerName")


@query(f"SELECT term, occurrences, records, {_MARK} AS mark FROM ({_FREQUENT.format(terms='SELECT id, BorrowerName AS term, 1 AS times FROM (' + _RECORDS + ')')})")
def p7_values(spark: SparkSession, folder: str) -> DataFrame:
    return frequencies(table(spark, folder, "companycleaner"), "id", "BorrowerName", by="value")


@query()
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    ranks = encoding.read_ranks(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    return encoding.encode_texts(table(spark, folder, "documents"), "doc_id", "text", ranks)


@query()
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")


# The subjects of the hand labels.
SUBJECTS = "science law sport software medicine finance travel food".split()


@query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    known = subjects.held_out_spans(table(spark, folder, "benchmark"))
    theta = subjects.train(docs, "doc_id", "text", table(spark, folder, "subject_labels"), "subject", SUBJECTS, known)
    return subjects.document_subjects(docs, "doc_id", "text", theta, SUBJECTS, known=known)
