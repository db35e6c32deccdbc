import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import queries as Q
from kinweave.functions import text as X
from kinweave.operators import components as C
from kinweave.operators import evidence as E
from kinweave.operators import similarity as S
from kinweave.operators.numbering import dense_number
from kinweave.operators.reduce_rank import dense_cosine, truncated_svd
from kinweave.operators.skew import counted_join, heavy_keys, heavy_sketch, key_chunks, key_summary, salted_join, sketched_join, sketched_keys
from kinweave.operators.suffixes import clean_entity_names
from kinweave.operators.vectorize import TOKENIZERS, cross_similarity, fit_idf, term_frequencies, weigh
from kinweave.plans import RecordLinker
from kinweave.plans.linking import override_labels
from kinweave.plans.script import density_clusters, read_rows, script_clusters
from kinweave.session import cut, cut_counting
from kinweave.sources import corpus, read_csv, sampled, with_row_index, write_csv
from kinweave.streaming import score_stream


def test_numbering(spark):
    df = spark.createDataFrame([(x % 7, x) for x in range(100)], "a int, b int").repartition(5)
    got = dense_number(df, ["a", "b"], "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted((x % 7, x) for x in range(100)) and [r.n for r in got] == list(range(100))
    assert dense_number(df.limit(0), ["a"], "n").count() == 0
    assert with_row_index(df, ["b"], start=1).agg(F.max("row_idx")).first()[0] == 100


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    keys = ["hot"] * 300 + [f"k{i % 40}" for i in range(200)] + [None] * 30
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    right = left.where("k IS NOT NULL AND k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    got = salted_join(left, right, ["k"], "n", 530, how, share=0.01, least=10)
    assert sorted(got.select("i", "k", "n").collect(), key=str) == sorted(left.join(right, "k", how).select("i", "k", "n").collect(), key=str)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_key_summary_equals_brute_force(spark, chunk):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), i, rng.choice(["x", "y", None])) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(3)
    got = {r["k"]: tuple(r)[1:] for r in key_summary(df, "k", ["i"], "v", chunk).collect()}
    for key in {r[0] for r in rows} - {None}:
        own = [v for k, i, v in sorted(rows, key=lambda r: r[1]) if k == key]
        changes = sum(x != y for x, y in zip(own, own[1:]))
        assert got.pop(key) == (len(own), -(-len(own) // chunk), own[0], own[-1], changes)
    assert not got
    sizes = key_chunks(df, "k", ["i"], chunk).groupBy("k", "_chunk").count().agg(F.max("count")).first()[0]
    assert sizes <= chunk


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [(None,)] * 2, "k string")
    assert {tuple(r)[:2] for r in heavy_keys(df, "k", share=0.4).collect()} == {("a", 5)}
    assert heavy_keys(df.limit(0), "k").count() == 0
    assert {r[0] for r in heavy_keys(df, "k", share=0.3).collect()} == {"a", "b"}


def test_tutorial_goldens(spark):
    fit, new = corpus(spark, ["yo", "mo"]), corpus(spark, ["yu", "mu"])
    char = TOKENIZERS["char"]
    idf = fit_idf(term_frequencies(fit, "row_idx", "text", char), 2)
    assert {r.term: round(r.idf, 8) for r in idf.collect()} == {"y": 1.40546511, "m": 1.40546511, "o": 1.0}
    sides = [weigh(term_frequencies(d, "row_idx", "text", char), idf, "row_idx", norm=False) for d in (fit, new)]
    got = {(r.idx1, r.idx2): round(r.similarity, 4) for r in cross_similarity(*sides, "row_idx", "row_idx").collect()}
    assert got == {(0, 0): 0.8148, (1, 1): 0.8148}


def test_prefix_filter_loses_nothing(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(60)], "i int, t string")
    vectors = S.class_vectors(S.value_classes(df, "i", "t"), "char_ngram")
    rows = {}
    for r in vectors.collect():
        rows.setdefault(r.class_id, {})[r.term] = r.w
    ids = sorted(rows)
    for t in (0.3, 0.7, 0.95):
        want = {}
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                s = sum(w * rows[b].get(k, 0) for k, w in rows[a].items())
                if s >= t:
                    want[a, b] = round(s, 9)
        assert {(r.idx1, r.idx2): round(r.similarity, 9) for r in S.cosine_pairs(vectors, t).collect()} == want


def test_single_tokens_never_match(spark):
    df = spark.createDataFrame([(0, "ACME"), (1, "ACME"), (2, "RED FOX INC"), (3, "RED FOX INC"), (4, None), (5, "nan")], "row_idx long, n string")
    labels = {r.row_idx: r.cluster_label for r in RecordLinker(df, {"n": {"threshold": 0.7}}).cluster().collect()}
    assert labels[2] == labels[3] and len(set(labels.values())) == 5
    assert sorted(set(labels.values())) == list(range(5))


def test_linker_rejects(spark):
    df = spark.createDataFrame([(0, "a")], "row_idx long, n string")
    for bad in ({}, {"n": {"threshold": 0.5, "similarity_method": "x"}}, {"n": {"similarity_method": "tfidf"}}):
        with pytest.raises(ValueError):
            RecordLinker(df, bad)
    with pytest.raises(ValueError):
        RecordLinker(df, {"n": {"threshold": 1}}, conditional="XOR")
    with pytest.raises(ValueError):
        S.block_columns("n", ["zodiac"], None)


def linked(spark, rows, rules, conditional="OR", constraints=None):
    df = spark.createDataFrame(rows, "row_idx long, a string, b string")
    c = spark.createDataFrame(constraints, "id1 long, id2 long, match boolean") if constraints else None
    return {r.row_idx: r.cluster_label for r in RecordLinker(df, rules, "row_idx", conditional, c).cluster().collect()}


ROWS = [(0, "red fox inc", "1 2"), (1, "red fox inc", "3 4"), (2, "blue owl co", "3 4"), (3, "blue owl co", "1 2"), (4, "red fox inc", "1 2")]
RULES = {"a": {"threshold": 0.9}, "b": {"threshold": 0.9, "similarity_method": "exact"}}


def test_or_and_rules(spark):
    assert len(set(linked(spark, ROWS, RULES).values())) == 1
    got = linked(spark, ROWS, RULES, "AND")
    assert got[0] == got[4] and len(set(got.values())) == 4


def test_constraints(spark):
    rule = {"b": RULES["b"]}
    assert linked(spark, ROWS, rule)[1] == linked(spark, ROWS, rule)[2]
    got = linked(spark, ROWS, rule, constraints=[(2, 1, False)])
    assert got[1] != got[2] and got[0] == got[3] == got[4]
    got = linked(spark, ROWS, rule, constraints=[(1, 2, False), (1, 2, True), (0, 1, True)])
    assert len(set(got.values())) == 1
    with pytest.raises(ValueError):
        linked(spark, ROWS, rule, constraints=[(0, 99, True)])


def test_cannot_link_keeps_bridges(spark):
    rows = [(0, "", "x"), (1, "", "x"), (2, "", "x"), (3, "", "y")]
    got = linked(spark, rows, {"b": RULES["b"]}, constraints=[(0, 1, False)])
    assert got[0] == got[1] == got[2] != got[3]


def test_explain_and_subgraph(spark):
    df = spark.createDataFrame([(0, "red fox den inc"), (1, "red fox den llc"), (2, "owl")], "row_idx long, n string")
    linker = RecordLinker(df, {"n": {"threshold": 0.3}})
    row = linker.explain().first()
    assert (row.idx1, row.idx2, row.n_idx1, row.n_idx2, row.cluster_label) == (0, 1, "red fox den inc", "red fox den llc", 0)
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    nodes, own = C.cluster_subgraph(linker.cluster(), "row_idx", edges, 0)
    assert nodes.count() == 2 and own.count() == 1


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(i, i + 1) for i in range(300, 330)]
    got = {r.node: r.root for r in C.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert got == {x: top(x) for x in parent}
    assert C.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_no_edges_label_rows(spark):
    rows = spark.createDataFrame([(5,), (3,)], "row_idx long")
    labels = spark.createDataFrame([], "node long, cluster_label long")
    assert {tuple(r) for r in C.label_rows(rows, "row_idx", labels).collect()} == {(3, 0), (5, 1)}


def test_dbscan(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "i long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.2)], "idx1 long, idx2 long, similarity double")
    got = {r.i: r.cluster_id for r in C.dbscan(rows, "i", pairs, 0.3, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1}
    assert {r.i: r.cluster_id for r in C.dbscan(rows, "i", pairs, 0.3, 1).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def test_dbscan_counts_copies(spark, tmp_path):
    rows = spark.createDataFrame([(0, 3), (1, 1), (2, 2), (3, 1)], "i long, n long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.9)], "idx1 long, idx2 long, similarity double")
    assert {r.i: r.cluster_id for r in C.dbscan(rows, "i", pairs, 0.3, 4, "n").collect()} == {0: 0, 1: 0, 2: -1, 3: -1}
    assert {r.i: r.cluster_id for r in C.dbscan(rows, "i", pairs, 0.3, 3, "n").collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    names = ["red fox", "red fox", "red fox", "blue sea", None, None, None, "nan", "nan", "nan"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.id: r.cluster_id for r in Q.dbscan_rows_m3(spark, str(tmp_path)).collect()} == {i: 0 if i < 3 else -1 for i in range(10)}


def test_evidence(spark):
    frame = lambda rows: spark.createDataFrame(rows, "idx1 long, idx2 long, similarity double")
    got = E.merge_evidence({"a": frame([(1, 2, 0.9), (2, 1, 0.5)]), "b": frame([(3, 1, None)])})
    assert {tuple(r) for r in got.collect()} == {(1, 2, 0.9, 0.0), (1, 3, 0.0, 0.0)}
    with pytest.raises(ValueError):
        E.merge_evidence({})


def test_suffix_cleaner(spark):
    names = [f"Number{i} Tower CONSTRUCTION INC" for i in range(25)] + ["Fish AND CONSTRUCTION INC", "Al INC", "INC", "", None]
    df = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)], "id long, name string, removed_by string")
    got = {r.id: r for r in clean_entity_names(df, "name").collect()}
    assert len(got) == len(names) and got[0].removed_by == "kept"
    assert got[0]["name_CLN"].startswith("Number0") and got[0]["0-ending"] == "INC" and got[0]["1-ending"] == "CONSTRUCTION"
    assert got[26]["name_CLN"] == "Al INC" and got[29]["name_CLN"] is None and got[28]["name_CLN"] == ""
    assert clean_entity_names(df.limit(0), "name").count() == 0


def test_svd_keeps_cosines_at_full_rank(spark):
    df = spark.createDataFrame([(0, "abcd"), (1, "abce"), (2, "xyz"), (3, "abcd")], "i long, t string")
    tf = term_frequencies(df, "i", "t", TOKENIZERS["char_ngram"])
    unit = truncated_svd(weigh(tf, fit_idf(tf, 4), "i", norm=False), "i", 10).cache()
    got = {(r.idx1, r.idx2): r.similarity for r in dense_cosine(unit.where("i = 0"), unit, "i", 0.1).collect()}
    assert abs(got[0, 3] - 1) < 1e-6 and 0.3 < got[0, 1] < 1 and (0, 2) not in got


def test_svd_query_asks_for_later_copies(spark, tmp_path):
    names = ["red fox", "red foxes", "blue sea", None]
    spark.createDataFrame([(i, names[i % 4]) for i in range(1, 103)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    pairs = {(r.idx1, r.idx2) for r in Q.svd_cosine(spark, str(tmp_path)).collect()}  # 50 is a copy of 2, 100 one of 4
    assert pairs == {(4, 1)}
    members = {r.row_idx: r.class_id for r in Q.part_name_members(spark, str(tmp_path)).collect()}
    assert members == {i: (i % 4) or 4 for i in range(1, 103) if i % 4 != 3}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "i int, t string")
    write_csv(df, str(tmp_path / "x"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "x"), df.schema).collect())) == [(1, "a,b"), (2, None)]
    assert read_csv(spark, str(tmp_path / "x")).count() == 2


def test_override(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "i int, k string, cluster_label long")
    fixed = spark.createDataFrame([("a", 9), ("a", 8)], "k string, cluster_label long")
    assert {(r.i, r.cluster_label) for r in override_labels(rows, ["k"], fixed).collect()} == {(1, 8), (2, 6)}


def test_stream_scoring(spark, tmp_path):
    fit = corpus(spark, ["red fox den", "red owl"])
    idf = fit_idf(term_frequencies(fit, "row_idx", "text", TOKENIZERS["tfidf"]), 2)
    (tmp_path / "in").mkdir()
    corpus(spark, ["red fox", None]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_idx long, text string").parquet(str(tmp_path / "in"))
    query = score_stream(stream, "row_idx", "text", idf).writeStream.format("memory").queryName("scored").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert [r.term for r in spark.table("scored").collect()] == ["red fox"]


def test_script_pipeline(spark, tmp_path):
    rows = [("First National Bank", "56-1 x"), ("Owl", "12-3 y"), ("First National Bnk", "56-9 z"), ("Fox and Den", "12-3 y"), (None, "q"), ("Lone", "zz")]
    write_csv(spark.createDataFrame(rows, "a string, b string").coalesce(1), str(tmp_path / "c"))
    table = read_rows(spark, str(tmp_path / "c"), ["a", "b"], head=100)
    got = {r.a: r.cluster_label for r in script_clusters(table, "a", "b").collect()}
    assert got["First National Bank"] == got["First National Bnk"] is not None and got["Owl"] == got["Fox and Den"] is not None
    assert got["Lone"] is None and len(got) == 5
    dense = {r.a: r.cluster_id for r in density_clusters(table, "row_idx", {"a": 0.7, "b": 0.8}).collect()}
    assert dense["Owl"] == dense["Fox and Den"] and len(set(dense.values())) == 3


def test_cosine_pairs_in_waves(spark, monkeypatch):
    """However many pairs the lists of common terms make, few are on disk at a time; the result is that of one wave."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(6, 12)))) for i in range(120)]
    vectors = cut(S.class_vectors(cut(S.value_classes(spark.createDataFrame(rows, "row_idx long, n string"), "row_idx", "n")), "char_ngram"))
    plain = {(r[0], r[1]): round(r[2], 9) for r in S.cosine_pairs(vectors, 0.6).collect()}
    written, write = [], S.cut_parts
    monkeypatch.setattr(S, "WAVE", 800)
    monkeypatch.setattr(S, "MOST_LIST", 9)
    monkeypatch.setattr(S, "cut_parts", lambda s, frames: write(s, (written.append(1) or f for f in frames)))
    for most in (S.MOST_TERMS, 1):
        monkeypatch.setattr(S, "MOST_TERMS", most)
        rows = S.cosine_pairs(vectors, 0.6).collect()
        assert len(rows) == len(plain) > 20 and {(r[0], r[1]): round(r[2], 9) for r in rows} == plain
    assert len(written) > 4


def test_own_tokenizer(spark):
    df = spark.createDataFrame([(0, "a-b"), (1, "b-a"), (2, "c")], "row_idx long, n string")
    rule = {"threshold": 0.9, "tokenizer": lambda c: F.split(c, "-")}
    labels = {r.row_idx: r.cluster_label for r in RecordLinker(df, {"n": rule}).cluster().collect()}
    assert labels[0] == labels[1] != labels[2]


def test_cannot_link_between_copies_under_and(spark):
    """Three equal rows stay together without the edge of two of them; two equal rows part."""
    rows = [(0, "red widget", "x"), (1, "red widget", "x"), (2, "red widget", "x"), (3, "blue bolt", "y"), (4, "blue bolt", "y")]
    df = spark.createDataFrame(rows, "row_idx long, a string, b string").withColumn("id", F.col("row_idx"))
    rules = {"a": {"threshold": 0.9, "similarity_method": "char_ngram"}, "b": {"threshold": 1.0, "similarity_method": "exact"}}
    links = spark.createDataFrame([(0, 1, False), (3, 4, False)], "id1 long, id2 long, match boolean")
    for conditional in ("AND", "OR"):
        got = {r.row_idx: r.cluster_label for r in RecordLinker(df, rules, conditional=conditional, constraints=links).cluster().collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def test_ids_follow_the_input(spark):
    df = spark.createDataFrame([("b c",), ("a b",), (None,), ("b c",)], "a string").coalesce(1)
    done = RecordLinker(df, {"a": {"threshold": 0.9, "similarity_method": "char_ngram"}}).cluster()
    assert [(r.row_idx, r.id, r.a) for r in done.orderBy("row_idx").collect()] == [(0, 1, "b c"), (1, 2, "a b"), (2, 3, None), (3, 4, "b c")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_by_broadcast_equal_join(spark, how):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 900).alias("k"), "id")
    left, seen = cut_counting(left, heavy=heavy_sketch("k"), n=F.count("*"))
    right = cut(left.where("k IS NOT NULL AND k <> 8").groupBy("k").agg(F.count("*").alias("c")))
    heavy = sketched_keys(seen["heavy"], 100)
    assert seen["n"] == 4000 and heavy == [7]
    want = sorted(left.join(right, "k", how).collect(), key=str)
    assert sorted(sketched_join(left, right, "k", heavy, how).select("k", "id", "c").collect(), key=str) == want
    if how == "inner":
        assert sorted(counted_join(left, right, ["k"], "c", 4000, least=100).select("k", "id", "c").collect(), key=str) == want


def test_cut_keeps_what_parquet_cannot_hold(spark):
    df = spark.sql("SELECT 1 AS a, INTERVAL 2 MONTHS AS b, CAST(NULL AS void) AS c")
    shown = lambda x: x.select("a", F.col("b").cast("string"), "c").collect()
    assert shown(cut(df)) == shown(df)
    assert cut(spark.range(0)).count() == 0


def test_counted_words(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in df.select(X.counted(F.col("w"))).collect()]
    assert [(t.term, t.tf) for t in got[0]] == [("a", 1), ("b", 2)] and not got[1] and not got[2]


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    values = [(i, " ".join(random.Random(i).choices(["red", "blue", "hot", "old", "ring", "bolt"], k=3))) for i in range(60)]
    df = spark.createDataFrame(values, "row_idx long, v string")
    vectors = cut(S.class_vectors(cut(S.value_classes(df, "row_idx", "v")), "char_ngram"))
    got = []
    for most in (2000, 3):
        monkeypatch.setattr(S, "MOST_LIST", most)
        got.append({(r[0], r[1]): round(r[2], 9) for r in S.cosine_pairs(vectors, 0.6).collect()})
    assert got[0] == got[1] and got[0]


def test_density_clusters_count_copies(spark):
    rows = spark.createDataFrame([(0, "red widget"), (1, "red widget"), (2, "red widgets"), (3, "green"), (4, None), (5, None)], "row_idx long, a string")
    got = {r.row_idx: r.cluster_id for r in density_clusters(rows, "row_idx", {"a": 0.5}, 0.3, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1}


def test_svd_at_rank_100_keeps_exact_cosines(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"t{int(j)}", float(rng.random() + 0.1)) for i in range(40) for j in rng.choice(150, 12, replace=False)]
    unit = {r.id: np.array(r.unit) for r in truncated_svd(spark.createDataFrame(rows, "id long, term string, w double"), "id", 100).collect()}
    full = np.zeros((40, 150))
    for i, t, w in rows:
        full[i, int(t[1:])] = w
    full /= np.linalg.norm(full, axis=1, keepdims=True)
    assert max(abs(float(unit[i] @ unit[j]) - float(full[i] @ full[j])) for i in range(40) for j in range(40)) < 1e-6


def test_sampling_is_repeatable(spark):
    df = spark.range(5000)
    some = {r.id for r in sampled(df, "id", 0.2).collect()}
    assert some == {r.id for r in sampled(df.repartition(7), "id", 0.2).collect()} and 800 < len(some) < 1200
