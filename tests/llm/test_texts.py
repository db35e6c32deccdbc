import base64
import random

import numpy as np
import pytest

from kinweave.llm import contamination as W
from kinweave.llm import encoding as N
from kinweave.llm import mail
from kinweave.llm import subjects as S

PATH = f"{N.TOKENIZERS}/byte_bpe_50k.tiktoken"


# 8


@pytest.fixture(scope="module")
def ranks():
    return N.read_ranks(PATH)


TEXTS = ["", None, "Hello  world's\n\n  it'll 12½ é😀", "a" * 5000, "\x00\x1c \t\r\n", "ﬁ ٣ \xa0x", base64.b64encode(bytes(range(256))).decode(), "don't DON'T 'sx"]


def test_ids_equal_tiktokens(spark, ranks):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=N.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in N.encode_texts(df, "doc_id", "text", ranks).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    encoder = N.Encoder(N.write_model(ranks))
    assert all(encoder.decode(got[i]) == (t or "") for i, t in enumerate(TEXTS))
    assert N.encode_texts(df.limit(0), "doc_id", "text", ranks).count() == 0


def test_every_piece_encodes_to_itself(ranks):
    encoder = N.Encoder(N.write_model(ranks))
    letters = N.byte_letters()
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    got = encoder.model.encode(["".join(letters[b] for b in raw) for raw, _ in pieces], out_type=int)
    assert sum(ids != [rank] for ids, (_, rank) in zip(got, pieces)) == 0


def test_split_for_ascii_equals_the_pattern():
    import re

    import regex

    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choices(" \t\n\r\x0b\x1c'sstmdrevel09aZ._-", k=rng.randint(1, 14)))
        assert re.findall(N.ASCII, t, re.A) == regex.findall(N.PATTERN, t) == regex.findall(N.FAST, t)


# 9

ITEM = "one two three four five six seven eight nine ten eleven twelve"
OTHER = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def as_mail(text, encoding="8bit", kind="text/plain"):
    if encoding == "base64":
        text = base64.encodebytes(text.encode()).decode()
    return f"From: a\nSubject: b\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {encoding}\n\n{text}"


def test_mail_parts():
    multi = "Subject: x\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nplain\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<p>caf=C3=A9 <b>b</b>old &amp; x</p>\n--B\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--B\nContent-Type: text/plain\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\naGk=\n--B--\n"
    got = [(k, a, t.strip()) for k, a, t in mail.parts(multi.replace("\n", "\r\n"))]
    assert got == [("plain", False, "plain"), ("html", False, "café bold & x"), ("plain", True, "hi")]
    assert list(mail.parts(None)) == list(mail.parts("")) == []
    assert [t for _, _, t in mail.parts("Content-Type: multipart/mixed\n\nno boundary")] == ["no boundary"]
    assert [t for _, _, t in mail.parts(as_mail("x", "base64")[:-3] + "!!")]


def test_first_lines_like_a_header_are_text():
    assert [t for _, _, t in mail.parts("Note: the quick brown fox\njumps.\n\nOver.")] == ["Note: the quick brown fox\njumps.\n\nOver."]
    assert [t for _, _, t in mail.parts("Note: x\nSubject: y\n\nOver.")] == ["Over."]
    assert [t for _, _, t in mail.parts("Content-Type: multipart/mixed; boundary=B\n\n--B\nTodo: buy\n\nmore\n--B--\n")] == ["Todo: buy\n\nmore"]


def test_text_files_of_any_type():
    part = "Content-Type: application/octet-stream; name=\"{}\"\nContent-Disposition: attachment\nContent-Transfer-Encoding: base64\n\naGk="
    assert [tuple(x) for x in mail.parts(part.format("a.txt"))] == [("plain", True, "hi")]
    assert list(mail.parts(part.format("a.png"))) == list(mail.parts(part.format("txt"))) == []


def test_deeply_nested_parts():
    text = "Content-Type: text/plain\n\ndeep"
    for i in range(1500):
        text = f"Content-Type: message/rfc822\n\n{text}" if i % 2 else f"Content-Type: multipart/mixed; boundary=B{i}\n\n--B{i}\n{text}\n--B{i}--"
    assert [t.strip() for _, _, t in mail.parts(text)] == ["deep"]


def test_copied_shares(spark):
    words = [f"w{i}" for i in range(30)]
    known = W.known_spans(spark.createDataFrame([(" ".join(words),), (None,), ("",), ("too short",)], "text string"), "text")
    texts = [words[3:14] + ["x"] * 11, words[:9], [], ["x", *words[5:15]], words[20:30] + words[:10]]
    assert [round(float(x), 3) for x in W.copied_shares(texts, known)] == [0.5, 0.0, 0.0, round(10 / 11, 3), 1.0]
    assert not W.copied_shares(texts, known[:0]).any()


def brute(docs, items):
    words = {i: W.word_list(t) for i, t in items}
    grams = {(i, tuple(w[k : k + 10])) for i, w in words.items() for k in range(len(w) - 9)}
    out = set()
    for d, t in docs:
        for s in W.mail_texts(t):
            w = W.word_list(s)
            runs = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
            out |= {(d, i) for i, g in grams if g in runs}
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_leaks_equal_brute_force(spark, most):
    rng = random.Random(6)
    words = ITEM.split()
    docs = [
        (0, as_mail("> One, two three. four\n> five six seven eight nine ten")),
        (1, as_mail("one two three four five six seven eight nine x ten eleven")),
        (2, as_mail("<div>three four five six <i>seven</i> eight nine<br>ten eleven twelve</div>", "base64", "text/html")),
        (3, as_mail(f"x {OTHER} y {ITEM}", "base64")),
        (4, None),
        (5, ""),
        (6, "word " * 20000),
    ] + [(10 + i, as_mail(" ".join(rng.choices(words, k=rng.randint(5, 60))) + " " + " ".join(words[rng.randrange(4) :][: rng.randint(8, 11)]))) for i in range(40)]
    items = [(1, ITEM), (2, OTHER), (3, "too short"), (4, None), (5, ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in W.leaked_items(d, "doc_id", "text", t, "item_id", "text", most_test_hashes=most).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, [(i, x) for i, x in items if x])
    assert W.leaked_items(d.limit(0), "doc_id", "text", t, "item_id", "text", most_test_hashes=most).count() == 0
    assert W.leaked_items(d, "doc_id", "text", t.limit(0), "item_id", "text", most_test_hashes=most).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(9)
    for _ in range(200):
        shared = [rng.choice("abcdef") for _ in range(10)]
        one = [rng.choice("abcdef") for _ in range(rng.randint(0, 9))] + shared + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        two = [rng.choice("uvw") for _ in range(rng.randint(0, 9))] + shared + [rng.choice("xyz") for _ in range(rng.randint(0, 9))]
        a, b = W.winnow([one], 5, 10)[1], W.winnow([two], 5, 10)[1]
        assert set(a.tolist()) & set(b.tolist())


# 10

NOUNS = {"law": "verdict judge appeal statute clause tribunal", "food": "pastry broth garlic oven menu skillet"}


def document(rng, subject, sentences=4):
    return as_mail(" ".join(f"We saw the {rng.choice(NOUNS[subject].split())} near the {rng.choice(NOUNS[subject].split())} on a slow day." for _ in range(sentences)))


def test_paragraphs():
    text = "One is here. Two is here. Three is here.\n\nShort. Only two.\n> A b 3.5. c is long. Second one!\n> Third one?\n>> Deep one."
    assert S.paragraphs(text) == ["One is here. Two is here. Three is here.", "A b 3.5. c is long. Second one! Third one?"]
    assert S.mail_paragraphs(None) == S.mail_paragraphs("") == []


@pytest.mark.parametrize("opening", ["On 12/25, A B wrote:", "-----Original Message-----\nFrom: a <a@b.test>\nSent: Fri", "________________________________", "[quoted text follows]"])
def test_chains_below_a_signature(opening):
    own, signature, old = "One is here. Two is here. Three is here.", "A. B.\nC. D. E. Office.", "Old is here. Older is here. Oldest is here."
    for mark in (">", "| ", "> > ", ""):
        text = f"{own}\n\n-- \n{signature}\n\n{opening}\n{mark}\n" + f"{mark}{old}\n\n--\n{signature}"
        assert S.paragraphs(text) == [own, old]
    assert S.paragraphs(f"{own}\n--\n{signature}\n> {old}\n--\n{signature}") == [own, old]
    assert S.paragraphs(f"{own}\n--\n{signature}\n\n{old}") == [own]


def test_gradient():
    rng = np.random.default_rng(0)
    f = S.Fit([["a", "bb", "ccccc"], ["bb"], ["longerword", "a"]], np.array([[1.0, 0], [0, 1], [0, 0]]))
    theta = S.start(2).astype(np.float64) + rng.standard_normal(len(S.start(2))) * 0.1

    def loss(t):
        emb, w, b = S.unpack(t, 2)
        total = 0.0
        for words, y in zip([["a", "bb", "ccccc"], ["bb"], ["longerword", "a"]], f.targets):
            mean = np.mean([emb[S.features(x)].mean(0) for x in words], 0) * 10
            z = mean @ w + b
            total += float(np.sum(np.log1p(np.exp(z)) - y * z))
        return total

    g = f.gradient(theta)
    for i in [S.features("bb")[0] * S.DIM, S.features("ccccc")[1] * S.DIM + 3, S.BUCKETS * S.DIM + 5, len(theta) - 1]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert abs((loss(theta + step) - loss(theta - step)) / 2e-5 - g[i]) < 1e-4


def test_subjects_are_learnt(spark):
    rng = random.Random(3)
    truth = {i: rng.choice(["law", "food"]) for i in range(120)}
    docs = [(i, document(rng, s)) for i, s in truth.items()] + [(500, None), (501, ""), (502, document(rng, "law", 2))]
    labels = [(i, truth[i] if rng.random() > 0.1 else rng.choice(["law", "food"])) for i in range(60)] * 2 + [(3, "unheard of"), (None, "law")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    theta = S.train(d, "doc_id", "text", l, "subject", ["law", "food"])
    got = {tuple(r) for r in S.document_subjects(d, "doc_id", "text", theta, ["law", "food"]).collect()}
    held_out = {(i, s) for i, s in truth.items() if i >= 60}
    assert len(got & held_out) >= 0.95 * len(held_out) and len({x for x in got if x[0] >= 60} - held_out) <= 3
    known = S.held_out_spans(spark.createDataFrame([(docs[7][1].partition("\n\n")[2],)], "text string"))
    without = {tuple(r) for r in S.document_subjects(d, "doc_id", "text", theta, ["law", "food"], known=known).collect()}
    assert 7 in {i for i, _ in got - without} and not without - got and without
    empty = S.train(d, "doc_id", "text", l.limit(0), "subject", ["law", "food"])
    assert S.document_subjects(d, "doc_id", "text", empty, ["law", "food"]).count() == 0
