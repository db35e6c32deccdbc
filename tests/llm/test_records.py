import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.llm.addresses import location_links, readings, same_locations, street_key
from kinweave.llm.copies import encode_values, formatting_copies
from kinweave.llm.distinctive import most_distinctive, term_scores
from kinweave.llm.frequency import frequencies
from kinweave.llm.grouping import link_groups
from kinweave.llm import names as llm_names
from kinweave.llm.names import SUFFIX, Matcher, expand_pairs, lcs, name_tokens, spelling_variants, variant_links


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1


def test_term_scores(spark):
    rows = [(0, "red fox", None), (1, "red owl", "x"), (2, "red red owl", ""), (3, "nan", "None"), (4, "...", "x"), (5, "red fox", None)]
    got = {(r.row_idx, r.field, r.term): r for r in term_scores(frame(spark, rows, "row_idx long, a string, b string"), "row_idx", ["a", "b"]).collect()}
    assert set(got) == {(0, "a", "red"), (0, "a", "fox"), (1, "a", "red"), (1, "a", "owl"), (2, "a", "red"), (2, "a", "owl"), (5, "a", "red"), (5, "a", "fox"), (1, "b", "x"), (4, "b", "x")}
    assert got[2, "a", "red"].tf == 2 and got[2, "a", "red"].df == 4 and got[0, "a", "fox"].df == 2
    assert got[0, "a", "fox"].z > got[0, "a", "red"].z
    assert got[0, "a", "fox"].n_terms == 2
    assert got[1, "b", "x"].z == 0.0
    assert term_scores(frame(spark, [], "row_idx long, a string"), "row_idx", ["a"]).count() == 0


def test_term_scores_keep_clashing_columns(spark):
    df = frame(spark, [(0, "a b", 1, 2)], "row_idx long, a string, term int, z int")
    assert {r.term for r in term_scores(df, "row_idx", ["a"]).collect()} == {"a", "b"}


def test_z_falls_as_the_collection_count_rises():
    for total, length in ((40.0, 3.0), (3e6, 5.0), (3e6, 300.0)):
        z = []
        for count in range(1, 30):
            alpha, rest = float(count), count - 1.0
            odds = math.log((1 + alpha) / (length + total - 1 - alpha)) - math.log((rest + alpha) / (total - length + total - rest - alpha))
            z.append(odds / math.sqrt(1 / (1 + alpha) + 1 / (rest + alpha)))
        assert all(a > b for a, b in zip(z, z[1:]))


def test_most_distinctive_terms_come_from_z(spark):
    rows = [(0, "red red fox"), (1, "red owl"), (2, "red owl elk"), (3, "red fox owl"), (4, "owl elk"), (5, "hen cat"), (6, "red")]
    scores = term_scores(frame(spark, rows, "row_idx long, a string"), "row_idx", ["a"], None, True)
    got = {r.row_idx: (r.term, r.df, r.n_terms) for r in most_distinctive(scores, "row_idx").collect()}
    df = Counter(w for _, t in rows for w in set(t.split()))
    for i, t in rows:
        ranked = sorted((df[w], w) for w in set(t.split()))
        assert got.get(i) == ((ranked[0][1], ranked[0][0], len(ranked)) if len(ranked) == 1 or ranked[0][0] < ranked[1][0] else None)
    broken = {r.row_idx for r in most_distinctive(scores.withColumn("z", F.lit(0.0)), "row_idx").collect()}
    assert broken == {6}  # where z says nothing, only a single word stands out


# 2


def brute_groups(pairs):
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("seed", range(2))
def test_link_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    pairs = [(rng.randrange(70), rng.randrange(70)) for _ in range(45)] + list(zip(chain, chain[1:])) + [(5000, i) for i in range(5001, 5060)] + [(9, 9), (777, 777)]
    df = frame(spark, pairs * 2 + [(None, 4), (4, None)], "idx1 long, idx2 long")
    assert {r.node: r.group_id for r in link_groups(df).collect()} == brute_groups(pairs)


def test_link_groups_of_nothing(spark):
    assert link_groups(frame(spark, [], "idx1 long, idx2 long")).count() == 0
    assert [tuple(r) for r in link_groups(frame(spark, [(3, 3)], "idx1 long, idx2 long")).collect()] == [(3, 3)]


# 3


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in "ab")
        assert lcs(a, b) == slow(a, b)


COMMON = dict.fromkeys("dental services bakery company william walter john".split(), 900)


def same_name(a, b):
    tokens = [name_tokens(x) for x in (a, b)]
    return Matcher(COMMON, 10_000).same(*tokens, *[[COMMON.get(t, 3) for t in x] for x in tokens])


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("william j rindtek vailprurt", "vailprurt bill rindtek", True),
        ("w rindtek vailprurt", "william rindtek vailprvrt", True),
        ("william rindtek vailprurt", "walter rindtek vailprurt", False),
        ("leonard rindtek vailprurt", "peggy l rindtek vailprurt", False),
        ("l rindtek vailprurt", "peggy l rindtek vailprurt", False),
        ("rindtek vailprurt dental services llc", "dental services of vailprurt and rindtek llc", True),
        ("rindtek vailprurt dntl svc llc", "the rindtek vailprurt dental services limited liability company", True),
        ("rindtekvailprurt dental services", "rindtek vailprurt dental services", True),
        ("rindtek vailprurt dental services llc", "rindtek vailprurt bakery company inc", False),
        ("rindtek vailprurt dental services", "rindtek vailprurt", True),
        ("rindtek vailprurt dental servces", "rindtek vailprurt dental", True),
        ("acme bakery llc", "acme bakery", True),
        ("acme bakery", "acmee bakery", True),
        ("john kowalczyk", "jon kowalczyk", True),
        ("kowalczyk llc", "kowalczyk inc", True),
        ("kowalczyk", "kowalski", False),
    ],
)
def test_names(a, b, same):
    assert same_name(a, b) is same and same_name(b, a) is same
    assert name_tokens("14899 fair gate road") == []


def expected_variants(names, n_names):
    forms = {i: " ".join(re.sub("[^a-z0-9]+", " ", n.lower().replace(",", "").replace(".", "")).split()) for i, n in enumerate(names) if n and n != "nan"}
    tokens = {i: name_tokens(f) for i, f in forms.items()}
    ends = Counter(p for t in {tuple(sorted(t)) for t in tokens.values()} for p in {w[-SUFFIX:] if len(w) > 1 else f"={w}" for w in t})
    matcher = Matcher({}, n_names)
    count = lambda t: [ends[w[-SUFFIX:] if len(w) > 1 else f"={w}"] for w in t]
    return {(i, j) for i in forms for j in forms if i < j and forms[i] != forms[j] and tokens[i] and tokens[j] and matcher.same(tokens[i], tokens[j], count(tokens[i]), count(tokens[j]))}


def some_names(seed):
    rng = random.Random(seed)
    given = ["William", "Walter", "Kate", "Daniel"]
    surnames = [a + b for a in ("Rind", "Vail", "Sam", "Chim", "Stomb", "Prean") for b in ("tek", "prurt", "nead", "crean", "brend", "cous")]
    names = []
    for _ in range(25):
        a, b = rng.sample(surnames, 2)
        names += [f"{rng.choice(given)} {a} {b}", f"{b}, {rng.choice(given)} {a}", f"{a} & {b} Dental Ltd", None, "", "nan", f"{a}x {b} DENTAL"]
    return [*names, "acme bakery llc", "Acme Bakery", "Acmee bakery", "john kowalczyk", "jon kowalczyk", "Kowalczyk LLC", "kowalczyk inc.", "kowalczyk llc"]


@pytest.mark.parametrize("block", [50, 12])
def test_blocking_finds_what_all_pairs_find(spark, monkeypatch, block):
    """With blocks of twelve names most suffixes have to be refined with other tokens."""
    monkeypatch.setattr(llm_names, "MOST_BLOCK", block)
    names = some_names(4)
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, n string")
    rows = spelling_variants(df, "row_idx", "n").collect()
    got = {tuple(r) for r in rows}
    tokens = {tuple(sorted(name_tokens(" ".join(re.sub("[^a-z0-9]+", " ", n.lower().replace(",", "").replace(".", "")).split())))) for n in names if n and n != "nan"}
    want = expected_variants(names, len(tokens))
    assert len(rows) == len(got) and got <= want and len(got) >= 0.95 * len(want)
    n = len(names) - 8
    assert {(n, n + 1), (n, n + 2), (n + 1, n + 2), (n + 3, n + 4), (n + 5, n + 6), (n + 6, n + 7)} <= got


def test_common_names_are_refined_with_another_field(spark, monkeypatch):
    monkeypatch.setattr(llm_names, "MOST_BLOCK", 2)
    rows = [(i, f"{g} {w} smith", f"{i // 2} Way") for i, (g, w) in enumerate([("john", "carter"), ("john", "cartr"), ("john", "cater"), ("jon", "carter"), ("jon", "cartr"), ("john", "cartar")])]
    df = spark.createDataFrame(rows, "row_idx long, n string, a string")
    plain, refined = ({tuple(r) for r in spelling_variants(df, "row_idx", "n", x).collect()} for x in (None, "a"))
    assert plain <= refined and {(0, 1), (2, 3), (4, 5)} <= refined


def all_pairs(names):
    """What comparing all pairs finds, with the counts that the operator gives its matcher."""
    forms = {i: " ".join(re.sub("[^a-z0-9]+", " ", n.lower().replace(",", "").replace(".", "")).split()) for i, n in enumerate(names) if n and n != "nan"}
    bags = {i: tuple(sorted(name_tokens(f))) for i, f in forms.items()}
    own = lambda w: w[-SUFFIX:] if len(w) > 1 else f"={w}"
    held = Counter(k for t in {*bags.values()} for k in {k for _, k, _ in llm_names.name_parts(t, llm_names.given_names())})
    words = Counter(w for t in {*bags.values()} for w in set(t) if len(w) > 1)
    n = len({*bags.values()} - {()})
    matcher = Matcher({w: c for w, c in words.items() if c > llm_names.GENERIC_SHARE * n}, n)
    same = lambda x, y: x == y or matcher.same(x, y, [held[own(w)] for w in x], [held[own(w)] for w in y])
    return {(i, j) for i in forms for j in forms if i < j and forms[i] != forms[j] and bags[i] and bags[j] and same(bags[i], bags[j])}


@pytest.mark.parametrize("block", [1, 2, 50])
def test_names_of_common_keys_are_all_compared(spark, monkeypatch, block):
    """Seventy spellings of one borrower share every key; two borrowers share only a word of many, their own ones being mistyped at the end."""
    monkeypatch.setattr(llm_names, "MOST_BLOCK", block)
    spellings = [f"R{a}indtek V{b}ailprurt Dental Services" for a in "bcdfghjklm" for b in "npqrstv"]
    others = [f"{a}{b} {c}{a} Services" for a in ("kort", "wick", "plau", "drem") for b in ("sund", "zeag", "foul", "tix") for c in ("bram", "clov", "gner", "hund")]
    names = [*spellings, *others, "Stombrel Jexrourt Services", "Stombrle Jexrorut Services", *[f"{g} {w} Smith" for g, w in (("john", "carter"), ("john", "cartr"), ("john", "cater"), ("jon", "carter"))]]
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, n string")
    rows = [tuple(r) for r in spelling_variants(df, "row_idx", "n").collect()]
    n = len(spellings)
    assert len(rows) == len(set(rows)) and set(rows) == all_pairs(names)
    assert len([r for r in rows if r[1] < n]) == n * (n - 1) // 2 and (n + len(others), n + len(others) + 1) in rows


@pytest.mark.parametrize("chunk, batch", [(1_500, 4_000), (20, 4_000), (1_500, 50)])
def test_chunks_of_a_common_key_find_what_all_pairs_find(spark, monkeypatch, chunk, batch):
    for k, v in (("MOST_BLOCK", 1), ("CHUNK", chunk), ("BATCH", batch)):
        monkeypatch.setattr(llm_names, k, v)
    names = some_names(7)
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, n string")
    rows = [tuple(r) for r in spelling_variants(df, "row_idx", "n").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == all_pairs(names)


def test_the_screen_passes_all_that_the_matcher_accepts():
    rng, given = random.Random(3), llm_names.given_names()
    parts = ["rind", "vail", "sam", "chim", "tek", "prurt", "o'i", "ll", "l0"]
    words = [*(a + b for a in parts for b in parts), "john", "johnny", "j0hn", "bi11", "william", "billy", "h", "r", "5", "services", "svcs", "s3rvices", "\u0436\u0443\u043a", "ab", "a" * 70, "fre", "ddie", "frederick"]

    def typed(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w[:i] + w[i + 1 :] or w, w[:i] + rng.choice("aeil015") + w[i:], w.translate(str.maketrans("ols", "015")), w[0]])

    lists = [[rng.choice(words) for _ in range(rng.randint(1, 4))] for _ in range(150)]
    lists += [rng.sample([typed(w) for w in x], len(x)) for x in lists] + [[x[0] + x[1], *x[2:]] for x in lists if len(x) > 1]
    lists += [["bor", "bor"], ["borbor" + "x", "bor"], ["borborxx"], ["borb", "orxx"], [f"w{i}" for i in range(450)], [f"w{i}" for i in range(449)], ["fre", "ddie"], ["frederick"]]
    for generic in ({}, {"services": 900, "john": 900}):
        matcher = Matcher(generic, 500)
        may = llm_names.screened(llm_names.Words(lists, given), llm_names.Words(lists[::-1], given))[:, ::-1]
        accepted = [(i, j) for i, x in enumerate(lists) for j, y in enumerate(lists) if matcher.same(x, y, [3] * len(x), [3] * len(y))]
        assert len(accepted) > 2 * len(lists) and all(may[i, j] for i, j in accepted)
    assert may.mean() < 0.5


def test_names_are_dealt_to_cells_in_waves(spark, monkeypatch):
    """Whatever number of chunks a key has, few repeated names are on disk at a time, and their shuffle files go with their wave."""
    for k, v in (("MOST_BLOCK", 2), ("CHUNK", 3), ("WAVE", 100)):
        monkeypatch.setattr(llm_names, k, v, raising=False)
    names = some_names(9)[:150]
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, n string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and "shuffle" in f}
    before, most, write = files(), [], llm_names.cut_parts
    monkeypatch.setattr(llm_names, "cut_parts", lambda s, frames: write(s, (most.append(len(files() - before)) or f for f in frames)))
    rows = [tuple(r) for r in spelling_variants(df, "row_idx", "n").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == all_pairs(names)
    assert len(most) > 4 and max(most) < 10


def test_names_with_numbers_are_names_and_addresses_are_not(spark):
    names = ["Studio 540 Dental LLC", "Studio 540 Dental", "studio 540 dentall", "Studio 541 Dental", "Bakery 1540", "Bakery 1541", "1540 Bakery Inc", "540 Fair Gate Road", "Fair Gate Rd 540", "540 fair gate raod", "540 fairgate, TX 75001", "fairgate 540 TX 75001"]
    df = spark.createDataFrame(list(enumerate(names)), "row_idx long, n string")
    assert {tuple(r) for r in spelling_variants(df, "row_idx", "n").collect()} == {(0, 1), (0, 2), (1, 2), (4, 6)}


def test_variants_of_nothing_and_links(spark):
    df = spark.createDataFrame([(0, "Acme Bakery"), (1, "acme  bakery"), (2, "Acme Bakery LLC"), (3, None), (4, "...")], "row_idx long, n string")
    assert {tuple(r) for r in variant_links(df, "row_idx", "n").collect()} == {(0, 0, 1), (1, 0, 1), (2, 2, 2), (4, 4, 0)}
    assert spelling_variants(df.limit(0), "row_idx", "n").count() == 0


def test_chunks_make_the_same_pairs(spark):
    members = spark.createDataFrame([(i, i % 3, 10) for i in range(30)], "_row long, _fid long, _n long")
    matches = spark.createDataFrame([(0, 1), (1, 2)], "f1 long, f2 long")
    plain, dealt = ([tuple(r) for r in expand_pairs(matches, members, n).collect()] for n in (1000, 3))
    assert sorted(plain) == sorted(dealt) and len(set(plain)) == len(plain) == 200


# 4


def test_readings():
    r = readings("14 n fair gate rd apt 2b ravenshaw oregon 80210 1234")[0]
    assert (r.number, r.direction, r.core, r.kind, r.unit, r.city, r.state, r.zip) == ("14", "n", "fairgate", "road", "2b", "ravenshaw", "or", "80210")
    assert readings("po box 12 ravenshaw or 80210")[0].core == "pobox"
    assert readings("florence mundtun") == [] and readings("") == []
    assert street_key(["tenth"]) == street_key(["10th"]) == street_key(["tentth"])


def test_locations(spark):
    rows = [
        (0, "14 North Fair Gate Road, Ravenshaw, OR 80210"),
        (1, "RAVENSHAW, OREGON 80210, 14 N. FAIR GATE RD"),
        (2, "14 Fair Gaet Rd Ravenshaw 80210"),
        (3, "16 North Fair Gate Road, Ravenshaw, OR 80210"),
        (4, "14 N Fair Gate Rd Apt 2, Ravenshaw, OR 80210"),
        (5, "14 N Fair Gate Rd #3, Ravenshaw, OR 80210"),
        (6, "14 Fair Gate Rd, Ravenshow, Oregon"),
        (7, "P.O. Box 14, Ravenshaw, OR 80210"),
        (8, "post office box 14 ravenshaw or"),
        (9, None),
        (10, "UNKNOWN"),
        (11, "14 north fair gate road ravenshaw OR 80210"),
    ]
    df = frame(spark, rows, "row_idx long, a string")
    got = {tuple(r) for r in same_locations(df, "row_idx", "a").collect()}
    house = [0, 1, 2, 4, 5, 6, 11]
    want = {(i, j) for i in house for j in house if i < j} - {(4, 5), (0, 11)} | {(7, 8)}
    assert got == want
    assert same_locations(df.limit(0), "row_idx", "a").count() == 0


def test_address_without_zip_in_a_city_of_many(spark):
    zips = range(80210, 80219)
    rows = [(i, f"{10 + i} Fair Gate Road, Ravenshaw, OR {z}") for i, z in enumerate(zips)]
    rows += [(100 + i, f"{10 + i} Fair Gate Rd, Ravenshaw, OR") for i in range(len(zips))]
    rows += [(200, "18 fair gate road ravenshaw oregon")]
    got = {tuple(r) for r in same_locations(frame(spark, rows, "row_idx long, a string"), "row_idx", "a").collect()}
    assert got == {(i, 100 + i) for i in range(len(zips))} | {(8, 200), (108, 200)}


def test_the_street_decides_among_the_zips_of_a_city(spark):
    zips = range(62700, 62709)
    rows = [(i, f"{3 + i} {'Main' if z == 62708 else 'Oak' if z < 62704 else 'Elm'} St, Springfield, IL {z}") for i, z in enumerate(zips)]
    rows += [(50, "11 Main St, Springfield, IL 62708"), (51, "12 Main Street, Springfield, IL 62708-1234"), (100, "12 main st springfield il"), (101, "11 Mian St Springfield Illinois")]
    got = {tuple(r) for r in same_locations(frame(spark, rows, "row_idx long, a string"), "row_idx", "a").collect()}
    assert got == {(51, 100), (8, 50), (8, 101), (50, 101)} - {(8, 50)}


def test_units_join_their_own_and_blank_ones(spark):
    rows = [(i, f"14 Fair Gate Rd{u}, Ravenshaw, OR 80210") for i, u in enumerate(["", " Apt 1", " unit 1", " Apt 2", " # 2"])]
    got = {tuple(r) for r in same_locations(frame(spark, rows, "row_idx long, a string"), "row_idx", "a").collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (3, 4)}
    links = {r.row_idx: (r.class_id, r.links) for r in location_links(frame(spark, rows, "row_idx long, a string"), "row_idx", "a").collect()}
    assert links == {0: (0, 4), 1: (1, 2), 2: (2, 2), 3: (3, 2), 4: (4, 2)}


# 6


def test_copies(spark):
    rows = [(3, "Red, Fox", "1 Way"), (1, "FOX red", "way 1"), (2, "red fox 1", "Way"), (4, "red red fox", "1 way"), (5, None, None), (6, "", "--"), (7, "red", None)]
    df = frame(spark, rows, "row_idx long, a string, b string")
    got = {r.row_idx: (r.first_id, r.copies) for r in formatting_copies(df, "row_idx", ["a", "b"]).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 2), 6: (5, 2), 7: (7, 1)}
    assert formatting_copies(df.limit(0), "row_idx", ["a", "b"]).count() == 0
    assert all(r.codes == sorted(r.codes) for r in encode_values(df, ["a", "b"]).collect())


# 7


def test_frequencies_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice([" ".join(rng.choices(["Hot", "a.b", "x", "y", f"w{i}"], k=rng.randint(1, 6))), None, "", "nan"])) for i in range(120)]
    rows += rows[:30]
    df = frame(spark, rows, "id long, n string").repartition(7)
    distinct = {(i, n) for i, n in rows if n not in (None, "", "nan")}
    count, held = Counter(), defaultdict(set)
    for i, n in distinct:
        for w in n.lower().replace(".", "").split():
            count[w] += 1
            held[w].add(i)
    total = len({i for i, _ in distinct})
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequencies(df, "id", "n").collect()}
    assert got == {w: (count[w], len(h), "rare" if len(h) == 1 else "common" if len(h) > 0.05 * total else None) for w, h in held.items()}
    values = {r.term: r.records for r in frequencies(df, "id", "n", by="value").collect()}
    assert values == {n: len({i for i, m in distinct if m == n}) for _, n in distinct}
    assert frequencies(df.limit(0), "id", "n").count() == 0
