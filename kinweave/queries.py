"""The registered queries of the core, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.functions.stopwords import ENGLISH
from kinweave.operators import components as C
from kinweave.operators import evidence as E
from kinweave.operators import similarity as S
from kinweave.operators.reduce_rank import dense_cosine, truncated_svd
from kinweave.operators.skew import counted_join, heavy_keys, key_summary
from kinweave.operators.suffixes import clean_entity_names, common_endings, pass_statistics
from kinweave.operators.suffixes import common_affixes as mine_affixes
from kinweave.operators.vectorize import TOKENIZERS, cross_similarity, fit_idf, term_frequencies, weigh
from kinweave.plans.linking import RecordLinker, attach_columns, override_labels
from kinweave.plans.linking import explain_pairs as explain
from kinweave.plans.linking import script_graph as build_script_graph
from kinweave.plans.script import script_clusters
from kinweave.session import cut, scratch_path
from kinweave.sources import distinct_rows, load_table, read_csv, with_row_index, write_csv

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


_HEAVY = """
    SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS key_value FROM {t} WHERE {f} IS NOT NULL GROUP BY {f}
    HAVING count(*) >= 0.02 * (SELECT count(*) FROM {t})"""


@query(_HEAVY.format(f="cluster_label", t="clustered") + " UNION ALL " + _HEAVY.format(f="BorrowerName", t="scan"))
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = (("clustered", "cluster_label"), ("scan", "BorrowerName"))
    parts = [heavy_keys(load_table(spark, folder, table).select(field), field, chunk_rows=250).select(F.lit(field).alias("field"), "key_value") for table, field in fields]
    return parts[0].unionByName(parts[1])


@query("""
    WITH s AS (SELECT BorrowerName, row_idx, lender, lag(lender) OVER w AS before, row_number() OVER w AS n
               FROM scan WHERE BorrowerName IS NOT NULL WINDOW w AS (PARTITION BY BorrowerName ORDER BY row_idx))
    SELECT BorrowerName AS key_value, count(*) AS n_rows, arg_min_null(lender, row_idx) AS first_value, arg_max_null(lender, row_idx) AS last_value,
           count(*) FILTER (n > 1 AND before IS DISTINCT FROM lender) AS n_changes
    FROM s GROUP BY 1""")
def p5_lender_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Per borrower name, how often the lender changes from one record to the next."""
    done = key_summary(load_table(spark, folder, "scan"), "BorrowerName", ["row_idx"], "lender", chunk_rows=100)
    return done.select(F.col("BorrowerName").alias("key_value"), "n_rows", "first_value", "last_value", "n_changes")


@query("SELECT cluster_label AS key_value, count(*) AS n_rows FROM clustered WHERE cluster_label IS NOT NULL GROUP BY 1")
def p5_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    done = key_summary(load_table(spark, folder, "clustered"), "cluster_label", chunk_rows=100)
    return done.select(F.col("cluster_label").alias("key_value"), "n_rows")


# ---- names -------------------------------------------------------------------------------------------------------

_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace({c}, '&', ' AND '), '[.,]', '', 'g'),
    '[!"#$%&''()*+/:;<=>?@\[\\\]^_`{{|}}~-]', ' ', 'g'), '[\s\p{{Z}}\x1c-\x1f\x{{85}}]+', ' ', 'g'))"""
_NAMES = "SELECT id, BorrowerName, " + _CLEAN.format(c="BorrowerName") + " AS cleaned FROM companycleaner"
_SPLIT = "CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ' ') END"
_PREP = ", ".join(f"'{w}'" for w in X.PREPOSITIONS)
_AFTER = "list_position(list_reverse(list_transform(w, lambda x: lower(x) IN (" + _PREP + "))), true) - 1"
_RESIDUAL = "CASE WHEN len(w) > {k} THEN length(array_to_string(w[1:len(w) - {k}], ' ')) ELSE 0 END"


def _cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "companycleaner").withColumn("cleaned", X.clean_name("BorrowerName"))


@query(f"SELECT id, BorrowerName, cleaned FROM ({_NAMES})")
def name_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder)


def _ending_sql(k: int) -> str:
    return f"""SELECT array_to_string(w[greatest(len(w) - {k - 1}, 1):], ' ') AS ending, count(*) AS n
        FROM (SELECT {_SPLIT.format(c="cleaned")} AS w FROM ({_NAMES}) WHERE cleaned IS NOT NULL) GROUP BY 1 HAVING count(*) >= 20"""


for _k in (1, 2, 3):
    QUERIES[f"common_endings_{_k}"] = lambda spark, folder, k=_k: common_endings(_cleaned(spark, folder), "cleaned", k, 20)
    SQL[f"common_endings_{_k}"] = _ending_sql(_k)


@query(f"""SELECT id, cleaned, after_preposition, coalesce(after_preposition <= 2, false) AS exempt
    FROM (SELECT id, cleaned, CASE WHEN {_AFTER} >= 0 THEN {_AFTER} END AS after_preposition
          FROM (SELECT *, {_SPLIT.format(c="cleaned")} AS w FROM ({_NAMES})))""")
def preposition_exempt(spark: SparkSession, folder: str) -> DataFrame:
    after = X.words_after_preposition("cleaned")
    return _cleaned(spark, folder).select("id", "cleaned", after.alias("after_preposition"), F.coalesce(after <= 2, F.lit(False)).alias("exempt"))


@query(f"""SELECT id, cleaned, CASE WHEN cleaned IS NOT NULL THEN {_RESIDUAL.format(k=1)} END AS residual_1,
    CASE WHEN cleaned IS NOT NULL THEN {_RESIDUAL.format(k=2)} END AS residual_2 FROM (SELECT *, {_SPLIT.format(c="cleaned")} AS w FROM ({_NAMES}))""")
def residual_len(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder).select("id", "cleaned", X.residual_length("cleaned", 1).alias("residual_1"), X.residual_length("cleaned", 2).alias("residual_2"))


def _suffix_sql(statistics: bool = False) -> str:
    ctes, old, removed = [f"p0 AS (SELECT *, cleaned AS c FROM ({_NAMES}))"], "p0", []
    for i, k in enumerate((3, 2, 1, 1), 1):
        r = f"r{i}"
        ctes.append(f"w{i} AS (SELECT *, {_SPLIT.format(c='c')} AS w FROM {old})")
        ctes.append(f"e{i} AS (SELECT array_to_string(w[greatest(len(w) - {k - 1}, 1):], ' ') AS ending FROM w{i} WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)")
        best = "CASE " + " ".join(f"WHEN len(w) >= {j} AND array_to_string(w[len(w) - {j - 1}:], ' ') IN (SELECT ending FROM e{i}) THEN {j}" for j in range(k, 0, -1)) + " END"
        ctes.append(f"x{i} AS (SELECT *, CASE WHEN coalesce(({_AFTER}) BETWEEN 0 AND {k}, false) OR ({_RESIDUAL.format(k=k)}) < 10 THEN NULL ELSE {best} END AS cut FROM w{i})")
        ctes.append(f"y{i} AS (SELECT * EXCLUDE (w, cut), CASE WHEN cut IS NULL THEN c ELSE array_to_string(w[1:len(w) - cut], ' ') END AS d, cut FROM x{i})")
        ctes.append(f"p{i} AS (SELECT * EXCLUDE (c, d, cut), d AS c, CASE WHEN cut IS NOT NULL THEN nullif(trim(replace(c, d, ''), '()'), '') END AS {r}{', d AS cln' if i == 3 else ''} FROM y{i})")
        old = f"p{i}"
        removed.insert(0, r)
    if statistics:
        passes = [
            f"SELECT {i} AS pass, {k} AS words, (SELECT count(*) FROM e{i}) AS endings, count(*) FILTER (({_AFTER}) BETWEEN 0 AND {k}) AS near_preposition, count(*) FILTER (({_RESIDUAL.format(k=k)}) < 10) AS short_rest FROM w{i} WHERE c IS NOT NULL"
            for i, k in enumerate((3, 2, 1, 1), 1)
        ]
        return f"WITH {', '.join(ctes)} {' UNION ALL '.join(passes)}"
    ends = f"string_split(trim(regexp_replace(concat_ws(' ', {', '.join(removed)}), ' +', ' ', 'g')), ' ')"
    cols = ", ".join(f"nullif(e[-{n + 1}], '') AS \"{n}-ending\"" for n in range(4))
    return f"WITH {', '.join(ctes)} SELECT id, BorrowerName, cln AS \"BorrowerName_CLN\", {cols} FROM (SELECT *, {ends} AS e FROM {old})"


@query(_suffix_sql())
def suffix_clean_full(spark: SparkSession, folder: str) -> DataFrame:
    return clean_entity_names(load_table(spark, folder, "companycleaner"), "BorrowerName")


@query(_suffix_sql(statistics=True))
def suffix_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return pass_statistics(load_table(spark, folder, "companycleaner"), "BorrowerName")


@query(f"SELECT \"0-ending\" AS last_word, count(*) AS n FROM ({_suffix_sql()}) GROUP BY 1")
def removed_endings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_clean_full(spark, folder).groupBy(F.col("0-ending").alias("last_word")).agg(F.count("*").alias("n"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(BorrowerName), '[\\s\\p{Z}]+')) AS word FROM companycleaner)
    WHERE length(word) >= 2 GROUP BY 1 HAVING count(*) >= 5""")
def common_affixes(spark: SparkSession, folder: str) -> DataFrame:
    return mine_affixes(load_table(spark, folder, "companycleaner"), "BorrowerName")


@query("SELECT row_idx, BorrowerName FROM scan WHERE BorrowerName IS NOT NULL AND BorrowerName NOT IN ('', 'nan', 'None')")
def sentinel_filter(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "scan").where(X.is_present("BorrowerName")).select("row_idx", "BorrowerName")


@query("SELECT nullif(BorrowerName[1], '') AS block, count(*) AS n, min(id) AS least FROM companycleaner WHERE nullif(BorrowerName[1], '') IS NOT NULL GROUP BY 1")
def block_first_letter(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_table(spark, folder, "companycleaner").withColumn("block", S.block_columns("BorrowerName", ["first_letter"], None)[0])
    return rows.where("block IS NOT NULL").groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query("SELECT row_number() OVER (ORDER BY loaded_at, row_idx) - 1 AS position, row_idx FROM scan")
def row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return with_row_index(load_table(spark, folder, "scan").select("loaded_at", "row_idx"), ["loaded_at", "row_idx"], "position").select("position", "row_idx")


@query("SELECT row_idx, BorrowerName, BorrowerAddress FROM scan ORDER BY row_idx LIMIT 1000")
def head_slice(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "scan").select("row_idx", "BorrowerName", "BorrowerAddress").orderBy("row_idx").limit(1000)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The nations written as CSV and read again."""
    path = scratch_path(spark)
    write_csv(load_table(spark, folder, "nation"), path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT row_idx, BorrowerName, lender FROM scan WHERE BorrowerName IS NOT NULL AND approved_on IS NOT NULL")
def drop_missing(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "scan").na.drop("any", subset=["BorrowerName", "approved_on"]).select("row_idx", "BorrowerName", "lender")


@query("SELECT n_name, row_number() OVER () AS id FROM nation")
def ids_in_input_order(spark: SparkSession, folder: str) -> DataFrame:
    return with_row_index(load_table(spark, folder, "nation").select("n_name"), [], "id", 1).select("n_name", "id")


@query("SELECT BorrowerName, min(row_idx) AS row_idx, arg_min_null(lender, row_idx) AS lender FROM scan GROUP BY 1")
def distinct_names(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_rows(load_table(spark, folder, "scan").select("row_idx", "BorrowerName", "lender"), ["BorrowerName"], "row_idx")


@query("SELECT row_idx, 'Node: ' || row_idx || '<br>BorrowerName: ' || coalesce(BorrowerName, '') || '<br>lender: ' || coalesce(lender, '') AS text FROM scan")
def hover_texts(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, "scan").select("row_idx", X.hover_text("row_idx", ["BorrowerName", "lender"]).alias("text"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part), e AS (SELECT p_partkey, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    p AS (SELECT p_partkey, CASE WHEN i = 1 THEN word || ' ' WHEN i = n THEN ' ' || word ELSE ' ' || word || ' ' END AS t,
        CASE WHEN word IN ('ring', 'small') AND i = n THEN 5 WHEN word IN ('ring', 'small') AND i = 1 THEN 7 ELSE 10 END AS times FROM e)
    SELECT p_partkey, term, sum(times)::BIGINT AS n FROM (SELECT p_partkey, times, unnest(list_transform(range(1, length(t) - 1), lambda k: t[k:k + 2])) AS term FROM p) GROUP BY 1, 2""")
def affix_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Trigrams of part names, weighed by place and by whether the word is a common affix."""
    terms = load_table(spark, folder, "part").select("p_partkey", F.explode(X.affix_trigrams("p_name", ["ring", "small"])).alias("term"))
    return terms.groupBy("p_partkey", "term").agg(F.count("*").alias("n"))


# ---- vectors and similarity ----------------------------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)
_TOKENS = {
    "tfidf": f"""(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i + 1], ' ')) || list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i + 2], ' ')))
        FROM (SELECT *, list_filter(regexp_extract_all(value, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS k FROM v)""",
    "own": "string_split(value, ' ') FROM v",
    "numeric": "regexp_extract_all(value, '\\p{Nd}+') FROM v",
    "char_ngram": "list_transform(range(1, length(k)), lambda i: k[i:i + 1]) FROM (SELECT *, regexp_replace(lower(value), '[\\s\\p{Z}]{2,}', ' ', 'g') AS k FROM v)",
}


def _vectors_sql(values: str, method: str) -> str:
    """values gives (id, value, n); the CTE u has unit vectors (id, value, term, w)."""
    return f"""v AS ({values}), tk AS (SELECT id, value, n, unnest({_TOKENS[method].replace(" FROM ", ") AS term FROM ", 1)}),
        tf AS (SELECT id, value, n, term, count(*) AS tf FROM tk GROUP BY ALL),
        idf AS (SELECT term, ln(((SELECT sum(n) FROM v) + 1) / (sum(n) + 1)) + 1 AS idf FROM tf GROUP BY 1),
        r AS (SELECT id, value, term, tf * idf AS w FROM tf JOIN idf USING (term)),
        u AS (SELECT id, value, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r)"""


def _pairs_sql(values: str, method: str, t: float, block: str = "true") -> str:
    return f"""{_vectors_sql(values, method)}, g AS (SELECT * FROM u WHERE value IS NOT NULL AND value NOT IN ('', 'nan', 'None')),
        pairs AS (SELECT a.id AS idx1, b.id AS idx2, sum(a.w * b.w) AS similarity FROM g a JOIN g b ON a.term = b.term AND a.id < b.id AND {block}
                  GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {t} - 1e-9)"""


_PART = "SELECT min(p_partkey) AS id, p_name AS value, count(*) AS n FROM part GROUP BY p_name"
_FIRM = "SELECT min(id) AS id, BorrowerName AS value, count(*) AS n FROM companycleaner GROUP BY BorrowerName"
_ADDRESS = "SELECT min(row_idx) AS id, BorrowerAddress AS value, count(*) AS n FROM scan GROUP BY BorrowerAddress"


def _tfidf(spark: SparkSession, folder: str, table: str, row_id: str, column: str, method: str) -> DataFrame:
    classes = cut(S.value_classes(load_table(spark, folder, table), row_id, column))
    return S.class_vectors(classes, method)


def _vector_query(name: str, table: str, row_id: str, column: str, method: str, values: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _tfidf(spark, folder, table, row_id, column, method).select(F.col("class_id").alias("id"), "term", F.round("w", 6).alias("w"))

    QUERIES[name] = run
    SQL[name] = f"WITH {_vectors_sql(values, method)} SELECT id, term, round(w, 6) AS w FROM u WHERE value NOT IN ('', 'nan', 'None')"


_vector_query("tfidf_char2", "part", "p_partkey", "p_name", "char_ngram", _PART)
_vector_query("tfidf_word23", "companycleaner", "id", "BorrowerName", "tfidf", _FIRM)
_vector_query("tfidf_numeric", "scan", "row_idx", "BorrowerAddress", "numeric", _ADDRESS)


@query(f"WITH {_pairs_sql(_PART, 'char_ngram', 0.7)} SELECT idx1, idx2, round(similarity, 6) AS similarity FROM pairs")
def cosine_pairs_char2(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of distinct part names, each represented by its smallest key."""
    return _part_pairs(spark, folder, 0.7).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


def _part_pairs(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    return S.cosine_pairs(_tfidf(spark, folder, "part", "p_partkey", "p_name", "char_ngram"), threshold)


@query(f"WITH {_pairs_sql(_FIRM, 'tfidf', 0.7, 'a.value[1] = b.value[1]')} SELECT idx1, idx2, round(similarity, 6) AS similarity FROM pairs")
def cosine_pairs_word23_blocked(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_table(spark, folder, "companycleaner")
    classes = cut(S.value_classes(rows, "id", "BorrowerName", S.block_columns("BorrowerName", ["first_letter"], None)))
    return S.cosine_pairs(S.class_vectors(classes, "tfidf"), 0.7).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_pairs_sql(_ADDRESS, 'numeric', 0.7)} SELECT idx1, idx2, round(similarity, 6) AS similarity FROM pairs")
def cosine_pairs_numeric(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _tfidf(spark, folder, "scan", "row_idx", "BorrowerAddress", "numeric")
    return S.cosine_pairs(vectors, 0.7).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_pairs_sql(_PART, 'char_ngram', 0.6)} SELECT idx1, idx2, similarity::FLOAT::DOUBLE AS similarity FROM pairs WHERE similarity::FLOAT >= 0.7::FLOAT")
def cosine_pairs_float32(spark: SparkSession, folder: str) -> DataFrame:
    """Scores tested again after rounding to single precision."""
    return S.cosine_pairs(_tfidf(spark, folder, "part", "p_partkey", "p_name", "char_ngram"), 0.7, float32_scores=True)


@query(f"WITH {_pairs_sql(_PART, 'own', 0.5)} SELECT idx1, idx2, round(similarity, 6) AS similarity FROM pairs")
def cosine_pairs_own_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    classes = cut(S.value_classes(load_table(spark, folder, "part"), "p_partkey", "p_name"))
    return S.cosine_pairs(S.class_vectors(classes, lambda c: X.words(X.squeeze(c))), 0.5).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


_LENT = "SELECT min(row_idx) AS id, BorrowerAddress AS value, lender, count(*) AS n FROM scan GROUP BY BorrowerAddress, lender"


@query(f"""WITH {_pairs_sql(_LENT, 'numeric', 0.7, 'a.value[1] = b.value[1]')} SELECT idx1, idx2, round(similarity, 6) AS similarity
    FROM pairs JOIN v a ON a.id = idx1 JOIN v b ON b.id = idx2 WHERE a.lender = b.lender""")
def cosine_pairs_composite_block(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses compared within lender and first character."""
    rows = load_table(spark, folder, "scan")
    classes = cut(S.value_classes(rows, "row_idx", "BorrowerAddress", S.block_columns("BorrowerAddress", ["first_letter", "blocking_column"], ["lender"])))
    return S.cosine_pairs(S.class_vectors(classes, "numeric"), 0.7).select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


@query("SELECT s_suppkey AS row_idx, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS class_id, count(*) OVER (PARTITION BY s_nationkey) - 1 AS links FROM supplier WHERE s_nationkey IS NOT NULL")
def exact_pairs_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Equality self-join as classes: every row's class and how many others equal it."""
    rows = load_table(spark, folder, "supplier")
    classes = cut(S.value_classes(rows, "s_suppkey", "s_nationkey"))
    members = S.membership(rows, "s_suppkey", "s_nationkey", classes)
    return members.join(classes.select("class_id", (F.col("n") - 1).alias("links")), "class_id").select(F.col("s_suppkey").alias("row_idx"), "class_id", "links")


@query("""WITH f AS (SELECT p_partkey, lower(p_name) AS k FROM part), fd AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT p_partkey, unnest(list_transform(range(1, length(k) + 1), lambda i: k[i])) AS term FROM f) GROUP BY 1),
    idf AS (SELECT term, ln(((SELECT count(*) FROM part) + 1) / (df + 1)) + 1 AS idf FROM fd),
    t AS (SELECT n_nationkey AS id, lower(n_name) AS k FROM nation), r AS (SELECT r_regionkey AS id, lower(r_name) AS k FROM region),
    a AS (SELECT id, term, count(*) * any_value(idf) AS w FROM (SELECT id, unnest(list_transform(range(1, length(k) + 1), lambda i: k[i])) AS term FROM t) JOIN idf USING (term) GROUP BY 1, 2),
    b AS (SELECT id, term, count(*) * any_value(idf) AS w FROM (SELECT id, unnest(list_transform(range(1, length(k) + 1), lambda i: k[i])) AS term FROM r) JOIN idf USING (term) GROUP BY 1, 2),
    an AS (SELECT id, sqrt(sum(w * w)) AS len FROM a GROUP BY 1), bn AS (SELECT id, sqrt(sum(w * w)) AS len FROM b GROUP BY 1)
    SELECT a.id AS idx1, b.id AS idx2, round(sum(a.w * b.w) / any_value(an.len) / any_value(bn.len), 6) AS similarity
    FROM a JOIN b USING (term) JOIN an ON a.id = an.id JOIN bn ON b.id = bn.id GROUP BY 1, 2""")
def cross_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Character model fitted on part names, applied to nations and regions, compared across."""
    part = load_table(spark, folder, "part")
    idf = cut(fit_idf(term_frequencies(part, "p_partkey", "p_name", TOKENIZERS["char"]), part.count()))
    sides = [weigh(term_frequencies(load_table(spark, folder, t), i, c, TOKENIZERS["char"]), idf, i, norm=False) for t, i, c in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))]
    return cross_similarity(*sides, "n_nationkey", "r_regionkey").select("idx1", "idx2", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_pairs_sql(_PART, 'char_ngram', 0.3)}, both_ways AS (SELECT idx1, idx2, similarity FROM pairs UNION ALL SELECT idx2, idx1, similarity FROM pairs)
    SELECT idx1, idx2, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY idx1 ORDER BY round(similarity, 9) DESC, idx2) AS rank FROM both_ways) WHERE rank <= 3""")
def topn_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _part_pairs(spark, folder, 0.3).withColumn("similarity", F.round("similarity", 9))
    return S.top_neighbours(pairs, 3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_pairs_sql(_PART, 'char_ngram', 0.5)}, two AS (SELECT idx1, idx2, similarity FROM pairs UNION ALL SELECT idx2, idx1, similarity FROM pairs),
    asked AS (SELECT DISTINCT c FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part WHERE p_name IS NOT NULL) WHERE p_partkey % 50 = 0)
    SELECT idx1, idx2, round(similarity, 6) AS similarity FROM two WHERE idx1 IN (SELECT c FROM asked)""")
def svd_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosines after projection, class by class; queries are the part names of any row whose key is divisible by 50, against
    all. `part_name_members` gives the rows of a class. The SQL has the exact cosines: there are fewer names than ranks."""
    part = load_table(spark, folder, "part")
    classes = cut(S.value_classes(part, "p_partkey", "p_name"))
    tf = cut(term_frequencies(classes, "class_id", "value", TOKENIZERS["char_ngram"], ("n",)))
    idf = fit_idf(tf, part.count(), "n")
    unit = cut(truncated_svd(weigh(tf, cut(idf), "class_id", norm=False), "class_id"))
    asked = S.membership(part.where("p_partkey % 50 = 0"), "p_partkey", "p_name", classes).select("class_id").distinct()
    found = dense_cosine(unit.join(asked, "class_id", "left_semi"), unit, "class_id", 0.5)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("SELECT p_partkey AS row_idx, min(p_partkey) OVER (PARTITION BY p_name) AS class_id FROM part WHERE p_name IS NOT NULL")
def part_name_members(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every part row, as the pairs of part names give it."""
    rows = load_table(spark, folder, "part")
    return S.membership(rows, "p_partkey", "p_name", cut(S.value_classes(rows, "p_partkey", "p_name"))).withColumnRenamed("p_partkey", "row_idx")


# ---- evidence, graph, labels ---------------------------------------------------------------------------------------

_SCORES = "coalesce(BorrowerName_similarity, 0) AS ns, coalesce(BorrowerAddress_similarity, 0) AS ads FROM evidence WHERE idx1 <> idx2"
_EDGE = "SELECT DISTINCT least(idx1, idx2) AS src, greatest(idx1, idx2) AS dst FROM (SELECT idx1, idx2, CASE WHEN isnan(ns) THEN 0 ELSE ns END AS ns, CASE WHEN isnan(ads) THEN 0 ELSE ads END AS ads FROM (SELECT idx1, idx2, " + _SCORES + ")) WHERE {rule}"
_OR = _EDGE.format(rule="ns >= 0.7 OR ads >= 0.8")
_RULES = {"BorrowerName": 0.7, "BorrowerAddress": 0.8}


def _edges(spark: SparkSession, folder: str, conditional: str = "OR") -> DataFrame:
    return E.edges_of(load_table(spark, folder, "evidence"), E.edge_rule(_RULES, conditional))


@query(_OR)
def edges_or(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@query(_EDGE.format(rule="ns >= 0.7 AND ads >= 0.8"))
def edges_and(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder, "AND")


@query("""SELECT least(idx1, idx2) AS idx1, greatest(idx1, idx2) AS idx2, max(coalesce(BorrowerName_similarity, 0)) AS name_similarity, max(coalesce(BorrowerAddress_similarity, 0)) AS address_similarity
    FROM evidence GROUP BY 1, 2""")
def evidence_outer(spark: SparkSession, folder: str) -> DataFrame:
    e = load_table(spark, folder, "evidence")
    return E.merge_evidence({"name": e.select("idx1", "idx2", F.col("BorrowerName_similarity").alias("similarity")), "address": e.select("idx1", "idx2", F.col("BorrowerAddress_similarity").alias("similarity"))})


def _constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 2, True), (5, 3, True), (411, 602, False), (684, 1796, False), (7, 8, False), (7, 8, True)], "id1 long, id2 long, match boolean")


_BOUND = f"""SELECT src, dst FROM ({_OR}) WHERE (src, dst) NOT IN (VALUES (411, 602), (684, 1796), (7, 8)) UNION SELECT * FROM (VALUES (1, 2), (3, 5), (7, 8)) t(src, dst)"""


@query(_BOUND)
def constrained_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Cannot-links, then must-links, on top of the OR rule; row_idx serves as the business id."""
    resolved = E.resolve_ids(load_table(spark, folder, "scan"), "row_idx", "row_idx", _constraints(spark))
    return E.constrain(_edges(spark, folder), resolved)


_REACH = "RECURSIVE e AS ({edges}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach AS (SELECT src AS node, src AS other FROM b UNION SELECT reach.node, b.dst FROM reach JOIN b ON reach.other = b.src), comp AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"


@query(f"WITH {_REACH.format(edges=_OR)} SELECT node, root FROM comp")
def components(spark: SparkSession, folder: str) -> DataFrame:
    return C.connected_components(_edges(spark, folder))


_LABELS = _REACH.format(edges=_OR) + ", labels AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster_label FROM comp)"


@query(f"WITH {_LABELS} SELECT row_idx, coalesce(cluster_label, (SELECT max(cluster_label) FROM labels) + row_number() OVER (PARTITION BY cluster_label IS NULL ORDER BY row_idx)) AS cluster_label FROM scan LEFT JOIN labels ON row_idx = node")
def evidence_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all scan rows from the evidence table; unlinked rows get labels of their own."""
    labels = cut(C.number_components(C.connected_components(_edges(spark, folder))))
    return C.label_rows(load_table(spark, folder, "scan").select("row_idx"), "row_idx", labels)


@query(f"""WITH {_LABELS} SELECT least(e.idx1, e.idx2) AS idx1, greatest(e.idx1, e.idx2) AS idx2, max(coalesce(BorrowerName_similarity, 0)) AS name_similarity, max(coalesce(BorrowerAddress_similarity, 0)) AS address_similarity,
    any_value(a.BorrowerName) AS "BorrowerName_idx1", any_value(b.BorrowerName) AS "BorrowerName_idx2", any_value(CASE WHEN la.cluster_label = lb.cluster_label THEN la.cluster_label END) AS cluster_label
    FROM evidence e LEFT JOIN scan a ON a.row_idx = least(e.idx1, e.idx2) LEFT JOIN scan b ON b.row_idx = greatest(e.idx1, e.idx2) LEFT JOIN labels la ON la.node = least(e.idx1, e.idx2) LEFT JOIN labels lb ON lb.node = greatest(e.idx1, e.idx2) GROUP BY 1, 2""")
def explain_pairs(spark: SparkSession, folder: str) -> DataFrame:
    labels = cut(C.number_components(C.connected_components(_edges(spark, folder))))
    return explain(evidence_outer(spark, folder), load_table(spark, folder, "scan"), "row_idx", ["BorrowerName"], labels)


@query(f"WITH {_LABELS} SELECT src, dst FROM e JOIN labels ON src = node WHERE cluster_label = 0")
def cluster_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of cluster 0; its nodes are `evidence_labels` of that label."""
    edges = cut(_edges(spark, folder))
    labels = C.number_components(C.connected_components(edges))
    return C.cluster_subgraph(labels.withColumnRenamed("node", "row_idx"), "row_idx", edges, 0)[1]


@query(f"""WITH {_LABELS}, n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS m FROM labels WHERE cluster_label = 0)
    SELECT node AS row_idx, round(cos(2 * pi() * i / m), 6) AS x, round(sin(2 * pi() * i / m), 6) AS y, 'Node: ' || node AS text FROM n""")
def cluster_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of cluster 0 with the coordinates and texts of a figure."""
    edges = cut(_edges(spark, folder))
    labels = cut(C.number_components(C.connected_components(edges)).withColumnRenamed("node", "row_idx"))
    nodes = C.cluster_layout(labels, "row_idx", edges, 0)[0]
    return nodes.select("row_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "text")


@query("""SELECT e.idx1, e.idx2, e.BorrowerName_similarity AS similarity, a.BorrowerName AS "BorrowerName_idx1", a.lender AS lender_idx1, b.BorrowerName AS "BorrowerName_idx2", b.lender AS lender_idx2
    FROM evidence e JOIN scan a ON a.row_idx = e.idx1 JOIN scan b ON b.row_idx = e.idx2""")
def attached_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs with columns of both ends."""
    pairs = load_table(spark, folder, "evidence").select("idx1", "idx2", F.col("BorrowerName_similarity").alias("similarity"))
    return attach_columns(pairs, load_table(spark, folder, "scan"), "row_idx", ["BorrowerName", "lender"])


@query("WITH c AS (SELECT BorrowerName, min(cluster_label) AS fixed FROM clustered WHERE cluster_label < 3 AND BorrowerName IS NOT NULL GROUP BY 1) SELECT row_idx, coalesce(fixed, cluster_label) AS cluster_label FROM clustered LEFT JOIN c USING (BorrowerName)")
def post_override(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_table(spark, folder, "clustered").select("row_idx", "BorrowerName", "cluster_label")
    fixed = rows.where("cluster_label < 3 AND BorrowerName IS NOT NULL").select("BorrowerName", "cluster_label")
    return override_labels(rows, ["BorrowerName"], fixed).select("row_idx", "cluster_label")


_TYPE = "SELECT min(p_partkey) AS id, p_type AS value, count(*) AS n FROM part GROUP BY p_type"


@query(f"""WITH n AS (WITH {_pairs_sql(_PART, 'char_ngram', 0.3)} SELECT * FROM pairs), t AS (WITH {_pairs_sql(_TYPE, 'char_ngram', 0.3)} SELECT * FROM pairs)
    SELECT idx1, idx2, round(max(similarity), 6) AS similarity FROM (SELECT * FROM n UNION ALL SELECT * FROM t) GROUP BY 1, 2""")
def max_combine(spark: SparkSession, folder: str) -> DataFrame:
    types = S.cosine_pairs(_tfidf(spark, folder, "part", "p_partkey", "p_type", "char_ngram"), 0.3)
    return S.max_similarity(_part_pairs(spark, folder, 0.3), types).withColumn("similarity", F.round("similarity", 6))


def _dbscan(spark: SparkSession, folder: str, least: int) -> DataFrame:
    """Density clustering of distinct part names, copies not counted; `dbscan_rows_m1` and `_m3` count and label rows."""
    names = load_table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return C.dbscan(names.select("id"), "id", cut(_part_pairs(spark, folder, 0.3)), 0.4, least)


_NEAR = f"near AS (SELECT idx1, idx2 FROM (WITH {_pairs_sql(_PART, 'char_ngram', 0.3)} SELECT * FROM pairs) WHERE similarity >= 0.6 - 1e-9), ids AS (SELECT min(p_partkey) AS id FROM part GROUP BY p_name)"
_DENSE = """WITH RECURSIVE {near}, two AS (SELECT idx1 AS src, idx2 AS dst FROM near UNION SELECT idx2, idx1 FROM near),
    core AS (SELECT id FROM ids LEFT JOIN two ON src = id GROUP BY id HAVING count(dst) + 1 >= {m}),
    reach AS (SELECT id AS node, id AS other FROM core UNION SELECT reach.node, two.dst FROM reach JOIN two ON reach.other = two.src WHERE two.dst IN (SELECT id FROM core)),
    lab AS (SELECT node, dense_rank() OVER (ORDER BY min(other)) - 1 AS l FROM reach GROUP BY node),
    bord AS (SELECT src AS node, min(l) AS l FROM two JOIN lab ON dst = node WHERE src NOT IN (SELECT id FROM core) GROUP BY 1)
    SELECT id, coalesce(lab.l, bord.l, -1) AS cluster_id FROM ids LEFT JOIN lab ON lab.node = id LEFT JOIN bord ON bord.node = id"""


@query(_DENSE.format(near=_NEAR, m=1))
def dbscan_m1(spark: SparkSession, folder: str) -> DataFrame:
    return _dbscan(spark, folder, 1)


@query(_DENSE.format(near=_NEAR, m=3))
def dbscan_m3(spark: SparkSession, folder: str) -> DataFrame:
    return _dbscan(spark, folder, 3)


def _dbscan_rows(spark: SparkSession, folder: str, least: int) -> DataFrame:
    """Density clustering of all part rows: class by class, each counting its rows. Names that match nothing, not even
    their copies, are rows of their own."""
    part = load_table(spark, folder, "part")
    vectors = cut(_tfidf(spark, folder, "part", "p_partkey", "p_name", "char_ngram"))
    classes = cut(S.value_classes(part, "p_partkey", "p_name"))
    members = S.membership(part, "p_partkey", "p_name", classes.join(vectors.select("class_id").distinct(), "class_id", "left_semi"))
    placed = cut(part.select("p_partkey").join(members, "p_partkey", "left").select("p_partkey", F.coalesce("class_id", "p_partkey").alias("class_id")))
    sizes = placed.groupBy("class_id").agg(F.count("*").alias("n"))
    found = cut(C.dbscan(sizes, "class_id", cut(S.cosine_pairs(vectors, 0.3)), 0.4, least, "n"))
    return counted_join(placed, found, ["class_id"], "n", placed.count()).select(F.col("p_partkey").alias("id"), "cluster_id")


_DENSE_ROWS = f"""WITH RECURSIVE near AS (SELECT idx1, idx2 FROM (WITH {_pairs_sql(_PART, 'char_ngram', 0.3)} SELECT * FROM pairs) WHERE similarity >= 0.6 - 1e-9),
    us AS (WITH {_vectors_sql(_PART, 'char_ngram')} SELECT DISTINCT id FROM u WHERE value NOT IN ('', 'nan', 'None')),
    firsts AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part),
    placed AS (SELECT p_partkey, CASE WHEN first IN (SELECT id FROM us) THEN first ELSE p_partkey END AS c FROM firsts),
    two AS (SELECT idx1 AS src, idx2 AS dst FROM near UNION SELECT idx2, idx1 FROM near UNION SELECT c, c FROM placed),
    core AS (SELECT src AS id FROM two JOIN placed ON c = dst GROUP BY src HAVING count(*) >= {{m}}),
    reach AS (SELECT id AS node, id AS other FROM core UNION SELECT reach.node, two.dst FROM reach JOIN two ON reach.other = two.src WHERE two.dst IN (SELECT id FROM core)),
    lab AS (SELECT node, dense_rank() OVER (ORDER BY min(other)) - 1 AS l FROM reach GROUP BY node),
    bord AS (SELECT src AS node, min(l) AS l FROM two JOIN lab ON dst = node WHERE src NOT IN (SELECT id FROM core) GROUP BY 1)
    SELECT p_partkey AS id, coalesce(lab.l, bord.l, -1) AS cluster_id FROM placed LEFT JOIN lab ON lab.node = c LEFT JOIN bord ON bord.node = c"""


@query(_DENSE_ROWS.replace("{m}", "1"))
def dbscan_rows_m1(spark: SparkSession, folder: str) -> DataFrame:
    return _dbscan_rows(spark, folder, 1)


@query(_DENSE_ROWS.replace("{m}", "3"))
def dbscan_rows_m3(spark: SparkSession, folder: str) -> DataFrame:
    return _dbscan_rows(spark, folder, 3)


@query("SELECT DISTINCT least(idx1, idx2) AS src, greatest(idx1, idx2) AS dst FROM (SELECT idx1, idx2, max(coalesce(BorrowerName_similarity, 0)) AS a, max(coalesce(BorrowerAddress_similarity, 0)) AS b FROM (SELECT least(idx1, idx2) AS idx1, greatest(idx1, idx2) AS idx2, BorrowerName_similarity, BorrowerAddress_similarity FROM evidence) GROUP BY 1, 2) WHERE idx1 <> idx2 AND (a > 0.5 OR b > 0.9)")
def script_graph(spark: SparkSession, folder: str) -> DataFrame:
    e = load_table(spark, folder, "evidence")
    sides = [e.select("idx1", "idx2", F.col(f"{c}_similarity").alias("similarity")) for c in ("BorrowerName", "BorrowerAddress")]
    return build_script_graph(*sides, 0.5, 0.9)


# ---- the whole plan ------------------------------------------------------------------------------------------------

_DOCS = "SELECT min(doc_id) AS id, text AS value, lang, count(*) AS n FROM documents GROUP BY text, lang"


def _hub_labels(ctes: str, edges: str, rows: str, row_id: str) -> str:
    """Labels of rows from edges of rows (0 and up) and classes (below 0)."""
    return f"""WITH RECURSIVE {ctes}, e AS ({edges}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        reach AS (SELECT src AS node, src AS other FROM b WHERE src >= 0 UNION SELECT reach.node, b.dst FROM reach JOIN b ON reach.other = b.src),
        comp AS (SELECT node, min(other) FILTER (other >= 0) AS root FROM reach GROUP BY 1 HAVING count(*) FILTER (other >= 0) > 1),
        labels AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster_label FROM comp)
        SELECT {row_id}, coalesce(cluster_label, coalesce((SELECT max(cluster_label) FROM labels), -1) + row_number() OVER (PARTITION BY cluster_label IS NULL ORDER BY {row_id})) AS cluster_label
        FROM {rows} LEFT JOIN labels ON {row_id} = node"""


_DOC_CTES = f"""pr AS (WITH {_pairs_sql(_DOCS, 'tfidf', 0.7)} SELECT idx1, idx2 FROM pairs JOIN v a ON a.id = idx1 JOIN v b ON b.id = idx2 WHERE a.lang = b.lang),
    us AS (WITH {_vectors_sql(_DOCS, 'tfidf')} SELECT DISTINCT id FROM u WHERE value NOT IN ('', 'nan', 'None')),
    m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS c FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL QUALIFY c IN (SELECT id FROM us))"""


@query(_hub_labels(_DOC_CTES, "SELECT doc_id AS src, -c - 1 AS dst FROM m UNION SELECT -idx1 - 1, -idx2 - 1 FROM pr", "documents", "doc_id"))
def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked by word 2-3-gram cosine of at least 0.7 within a language, labelled."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("row_idx", F.col("doc_id"))
    rule = {"threshold": 0.7, "similarity_method": "tfidf", "blocking_criteria": ["blocking_column"], "blocking_column": "lang"}
    return RecordLinker(docs, {"text": rule}, id_column="doc_id").cluster().select("doc_id", "cluster_label")


def _linker(spark: SparkSession, folder: str, conditional: str) -> RecordLinker:
    rows = load_table(spark, folder, "scan").select("row_idx", "BorrowerName", "BorrowerAddress")
    rules = {"BorrowerName": {"threshold": 0.7}, "BorrowerAddress": {"threshold": 0.8, "similarity_method": "numeric"}}
    return RecordLinker(rows, rules, conditional=conditional)


_BORROWER = "SELECT min(row_idx) AS id, BorrowerName AS value, count(*) AS n FROM scan GROUP BY BorrowerName"
_SCAN_EVIDENCE = f"""nm AS (WITH {_pairs_sql(_BORROWER, 'tfidf', 0.7)} SELECT * FROM pairs), ad AS (WITH {_pairs_sql(_ADDRESS, 'numeric', 0.8)} SELECT * FROM pairs)"""


@query(f"WITH {_SCAN_EVIDENCE} SELECT coalesce(nm.idx1, ad.idx1) AS idx1, coalesce(nm.idx2, ad.idx2) AS idx2, round(coalesce(nm.similarity, 0), 6) AS name_similarity, round(coalesce(ad.similarity, 0), 6) AS address_similarity FROM nm FULL JOIN ad ON nm.idx1 = ad.idx1 AND nm.idx2 = ad.idx2")
def linker_evidence(spark: SparkSession, folder: str) -> DataFrame:
    found = _linker(spark, folder, "OR").evidence()
    return found.select("idx1", "idx2", F.round("BorrowerName_similarity", 6).alias("name_similarity"), F.round("BorrowerAddress_similarity", 6).alias("address_similarity"))


def _full_sql(pairs: str) -> str:
    return f"""WITH RECURSIVE {_scan_ctes()},
        {pairs}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),"""


def _scan_ctes() -> str:
    return f"""{_SCAN_EVIDENCE}, usn AS (SELECT DISTINCT id FROM (WITH {_vectors_sql(_BORROWER, 'tfidf')} SELECT id FROM u WHERE value NOT IN ('', 'nan', 'None'))),
        usa AS (SELECT DISTINCT id FROM (WITH {_vectors_sql(_ADDRESS, 'numeric')} SELECT id FROM u WHERE value NOT IN ('', 'nan', 'None'))),
        mn AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY BorrowerName) AS c FROM scan WHERE BorrowerName IS NOT NULL QUALIFY c IN (SELECT id FROM usn)),
        ma AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY BorrowerAddress) AS c FROM scan WHERE BorrowerAddress IS NOT NULL QUALIFY c IN (SELECT id FROM usa))"""


@query(_hub_labels(_scan_ctes(), """SELECT row_idx AS src, -2 * c - 1 AS dst FROM mn UNION SELECT row_idx, -2 * c - 2 FROM ma
    UNION SELECT -2 * idx1 - 1, -2 * idx2 - 1 FROM nm UNION SELECT -2 * idx1 - 2, -2 * idx2 - 2 FROM ad""", "scan", "row_idx"))
def linker_or(spark: SparkSession, folder: str) -> DataFrame:
    return _linker(spark, folder, "OR").cluster().select("row_idx", "cluster_label")


@query(_full_sql("""ln AS (SELECT idx1, idx2 FROM nm UNION SELECT idx2, idx1 FROM nm UNION SELECT id, id FROM usn), la AS (SELECT idx1, idx2 FROM ad UNION SELECT idx2, idx1 FROM ad UNION SELECT id, id FROM usa),
        e AS (SELECT DISTINCT x.row_idx AS src, y.row_idx AS dst FROM ma x JOIN la ON la.idx1 = x.c JOIN ma y ON la.idx2 = y.c JOIN mn p ON p.row_idx = x.row_idx JOIN mn q ON q.row_idx = y.row_idx JOIN ln ON ln.idx1 = p.c AND ln.idx2 = q.c WHERE x.row_idx < y.row_idx)""") + """
    reach AS (SELECT src AS node, src AS other FROM b UNION SELECT reach.node, b.dst FROM reach JOIN b ON reach.other = b.src), comp AS (SELECT node, min(other) AS root FROM reach GROUP BY 1), labels AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster_label FROM comp)
    SELECT row_idx, coalesce(cluster_label, (SELECT max(cluster_label) FROM labels) + row_number() OVER (PARTITION BY cluster_label IS NULL ORDER BY row_idx)) AS cluster_label FROM scan LEFT JOIN labels ON row_idx = node""")
def linker_and(spark: SparkSession, folder: str) -> DataFrame:
    return _linker(spark, folder, "AND").cluster().select("row_idx", "cluster_label")


_SIZES = "SELECT c AS id, count(*) AS n FROM {m} GROUP BY 1"
_MEMBER = """SELECT row_idx, '{f}' AS "column", c AS class_id, s.n, coalesce(l.links, 0)::BIGINT AS links FROM {m} JOIN ({sizes}) s ON s.id = c LEFT JOIN
    (SELECT a AS id, sum(n) AS links FROM (SELECT idx1 AS a, idx2 AS b FROM {p} UNION ALL SELECT idx2, idx1 FROM {p}) JOIN ({sizes}) ON id = b GROUP BY 1) l ON l.id = c"""


@query(f"WITH {_scan_ctes()} " + " UNION ALL ".join(_MEMBER.format(f=f, m=m, p=p, sizes=_SIZES.format(m=m)) for f, m, p in (("BorrowerName", "mn", "nm"), ("BorrowerAddress", "ma", "ad"))))
def linker_members(spark: SparkSession, folder: str) -> DataFrame:
    """Beside `linker_evidence`: every row's class per column, the rows of the class and those that match it."""
    return _linker(spark, folder, "OR").members()


def _constrained_labels(edges: str, rows: str, row_id: str) -> str:
    return f"""WITH {_REACH.format(edges=edges)}, labels AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster_label FROM comp)
        SELECT {row_id}, coalesce(cluster_label, coalesce((SELECT max(cluster_label) FROM labels), -1) + row_number() OVER (PARTITION BY cluster_label IS NULL ORDER BY {row_id})) AS cluster_label FROM {rows} LEFT JOIN labels ON {row_id} = node"""


_SAME_NATION = "SELECT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"


@query(_constrained_labels(f"SELECT * FROM ({_SAME_NATION}) WHERE (src, dst) NOT IN (VALUES (8, 17), (14, 28), (30, 54), (30, 55)) UNION SELECT * FROM (VALUES (1, 24), (33, 83)) t(src, dst)", "supplier", "s_suppkey"))
def linker_constrained_or(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of one nation under must-links and cannot-links: two parted, three kept together by the third, one taken out."""
    rules = {"s_nationkey": {"threshold": 1.0, "similarity_method": "exact"}, "s_name": {"threshold": 0.99, "similarity_method": "numeric"}}
    links = spark.createDataFrame([(8, 17, False), (28, 14, False), (30, 54, False), (55, 30, False), (1, 24, True), (33, 83, True), (33, 83, False)], "id1 long, id2 long, match boolean")
    rows = load_table(spark, folder, "supplier").withColumn("row_idx", F.col("s_suppkey"))
    return RecordLinker(rows, rules, "s_suppkey", "OR", links).cluster().select("s_suppkey", "cluster_label")


_SAME_PART = f"""SELECT x.p_partkey AS src, y.p_partkey AS dst FROM fp x JOIN fp y ON x.p_type = y.p_type AND x.p_partkey < y.p_partkey
    WHERE x.c = y.c OR (least(x.c, y.c), greatest(x.c, y.c)) IN (SELECT idx1, idx2 FROM np)"""


@query(_constrained_labels(f"SELECT * FROM ({_SAME_PART}) WHERE (src, dst) NOT IN (VALUES (0, 587), (11, 318), (6, 1207), (6, 1247)) UNION SELECT * FROM (VALUES (2, 12)) t(src, dst)", "part", "p_partkey")
    .replace("WITH RECURSIVE", f"WITH RECURSIVE np AS (WITH {_pairs_sql(_PART, 'char_ngram', 0.8)} SELECT idx1, idx2 FROM pairs), fp AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part),", 1))
def linker_constrained_and(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of like names and one type; cannot-links between copies of one class leave the class whole."""
    rules = {"p_name": {"threshold": 0.8, "similarity_method": "char_ngram"}, "p_type": {"threshold": 1.0, "similarity_method": "exact"}}
    links = spark.createDataFrame([(0, 587, False), (11, 318, False), (6, 1207, False), (1247, 6, False), (2, 12, True)], "id1 long, id2 long, match boolean")
    rows = load_table(spark, folder, "part").withColumn("row_idx", F.col("p_partkey"))
    return RecordLinker(rows, rules, "p_partkey", "AND", links).cluster().select("p_partkey", "cluster_label")


_SCRIPT = f"""nm AS (WITH {_pairs_sql(_BORROWER, 'char_ngram', 0.9)} SELECT * FROM pairs WHERE similarity > 0.9), ad AS (WITH {_pairs_sql(_ADDRESS, 'char_ngram', 0.95)} SELECT * FROM pairs WHERE similarity > 0.95),
    usn AS (SELECT DISTINCT id FROM (WITH {_vectors_sql(_BORROWER, 'char_ngram')} SELECT id FROM u WHERE value NOT IN ('', 'nan', 'None'))),
    usa AS (SELECT DISTINCT id FROM (WITH {_vectors_sql(_ADDRESS, 'char_ngram')} SELECT id FROM u WHERE value NOT IN ('', 'nan', 'None'))),
    mn AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY BorrowerName) AS c FROM scan WHERE BorrowerName IS NOT NULL QUALIFY c IN (SELECT id FROM usn)),
    ma AS (SELECT row_idx, min(row_idx) OVER (PARTITION BY BorrowerAddress) AS c FROM scan WHERE BorrowerAddress IS NOT NULL QUALIFY c IN (SELECT id FROM usa))"""


@query(_hub_labels(_SCRIPT, """SELECT row_idx AS src, -2 * c - 1 AS dst FROM mn UNION SELECT row_idx, -2 * c - 2 FROM ma
    UNION SELECT -2 * idx1 - 1, -2 * idx2 - 1 FROM nm UNION SELECT -2 * idx1 - 2, -2 * idx2 - 2 FROM ad""", "scan", "row_idx").rpartition("SELECT row_idx, coalesce")[0] + "SELECT row_idx, cluster_label FROM scan LEFT JOIN labels ON row_idx = node")
def script_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Two columns under character bigrams and two thresholds; rows without a link have no label."""
    rows = load_table(spark, folder, "scan").select("row_idx", "BorrowerName", "BorrowerAddress")
    return script_clusters(rows, "BorrowerName", "BorrowerAddress", 0.9, 0.95, 0.9, 0.95).select("row_idx", "cluster_label")
