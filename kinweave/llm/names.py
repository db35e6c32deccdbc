"""Variant spellings of the names of persons and firms: suffix blocking and token-wise longest common subsequences."""

from __future__ import annotations

import math
import re
from itertools import combinations, combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import is_present, normal_form
from kinweave.llm.worker import kept
from kinweave.operators.skew import LEAST_HEAVY, counted_join, salted_join
from kinweave.session import cut, cut_counting, cut_parts, release

SUFFIX = 6  # letters of the indexed token ends; shorter tokens are indexed whole
LEAST_TOKEN = 2
MOST_BLOCK = 50  # names of a key that are paired one by one; all pairs of a commoner key are screened first
CHUNK = 1_500  # names of a common key that a task screens against as many others
WAVE = 400_000  # names repeated for cells that are on disk at a time, or as many as there are different names
BATCH = 4_000  # words of the names that are screened at a time
LONG_NAME = 400  # words; a longer name is compared without a screen
ALIKE = 0.75  # longest-common-subsequence ratio of two spellings of a token
GENERIC_SHARE = 0.002  # of all names; a left-over token that looks like so common a one weighs no more than that
MARGIN, LEFT_OVER = 1.0, 0.5  # nats beyond a chance agreement; share of the agreement that one side may have besides
PRIOR_NAMES, PRIOR_SHARE = 1_000.0, 1e-4  # what is assumed of a token's share before any name is seen

# Words that are no part of a name, words of an address, and common English short forms of given names.
TITLES = "mr mrs ms mx miss dr prof rev sir madam".split()
PARTICLES = "the of and".split()
STREETS = """
street str st avenue ave av aven boulevard blvd boul blv drive dr drv lane ln la road rd court ct crt place pl terrace ter terr parkway pkwy pky
pkway highway hwy hgwy hiway circle cir square sq trail trl way wy alley aly loop lp box
""".split()
LEGAL = "llc llp lp inc incorporated corp corporation ltd limited liability partnership plc pc".split()
SHORT_NAMES = """
alexander: alex sandy xander al; andrew: andy drew; anthony: tony; barbara: barb barbie; benjamin: ben benny benji; catherine: kate kathy cathy
kit kitty katie cath; charles: charlie chuck; christopher: chris kit topher; daniel: dan danny; david: dave davey; deborah: deb debbie debby;
donald: don donny; dorothy: dot dottie dolly dora; edward: ed eddie ted ned teddy; elizabeth: liz lizzie beth betty eliza betsy; florence: flo
florrie flossie; francis: frank fran frankie; frederick: fred freddy freddie; gabriella: gabby ella gabi; gerald: gerry jerry; gregory: greg
gregg; harold: harry hal; henrietta: hetty hattie etta henny; henry: harry hank; james: jim jimmy jamie; jennifer: jen jenny jenn; john: jack
johnny; joseph: joe joey jo; kenneth: ken kenny; lawrence: larry laurie; leonard: len lenny leo; margaret: peggy maggie meg marge greta; matthew:
matt matty; michael: mike mick mickey micky; nathaniel: nate nat nathan; nicholas: nick nicky nico; patricia: pat patty trish tricia; peter: pete;
rebecca: becky becca; richard: rich rick dick ricky; robert: bob rob bobby robbie bert; ronald: ron ronnie; samuel: sam sammy; stephen: steve
stevie steven; susan: sue susie; theodore: ted teddy theo; thomas: tom tommy; timothy: tim timmy; victoria: vicky vic tori vickie; vincent: vince
vinny vin; walter: walt wally wat; william: will bill billy willie liam; winifred: winnie freda
"""
_FOLDED = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
_DIGITS = (str.maketrans("015", "ois"), str.maketrans("015", "ols"))
_COMPANY = re.compile(r"\blimited liability (company|partnership)\b")


def given_names() -> dict[str, frozenset[str]]:
    """Every listed name and short form with the full names it can stand for."""
    out: dict[str, set[str]] = {}
    for entry in SHORT_NAMES.split(";"):
        full, _, shorts = entry.partition(":")
        for name in (full, *shorts.split()):
            out.setdefault(name.strip(), set()).add(full.strip())
    return {k: frozenset(v) for k, v in out.items()}


def is_address(words: list[str]) -> bool:
    """Two numbers of three or more digits, or one and a word for a street, also a mistyped one if the number comes first."""
    numbers = [w for w in words if w.isdigit() and len(w) > 2]
    if len(numbers) != 1 or not {*STREETS}.isdisjoint(words):
        return bool(numbers)
    return words[0] == numbers[0] and any(5 * lcs(w, k) >= 2 * (len(w) + len(k)) for w in words if len(w) > 3 for k in STREETS if len(k) > 3)


def name_tokens(form: str) -> list[str]:
    """The words of a normal form that carry its name, accents folded; none if it is an address."""
    words = _COMPANY.sub("llc", form.translate(_FOLDED)).split()
    if is_address(words):
        return []
    drop = {*TITLES, *PARTICLES, *LEGAL}
    return [w for w in words if w not in drop]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def weight(count: float, names: float) -> float:
    """What it tells that two names share a token of so many names, in nats; few names count little against the prior."""
    return math.log((names + PRIOR_NAMES) / (count + PRIOR_NAMES * PRIOR_SHARE))


class Matcher:
    """Whether two token lists can be one name. generic: the tokens of many names, with their counts; names: how many there are.

    Tokens are paired one to one by the ratio of their longest common subsequence. The names are the same if every
    token finds its partner, or if what agrees tells more than the number of names (so that a chance agreement is not
    to be expected) and what one side has besides tells at most half as much. What remains on both sides contradicts.
    """

    def __init__(self, generic: dict[str, int], names: int) -> None:
        self.generic, self.n, self.names, self.seen, self.left = generic, names, given_names(), {}, {}
        self.enough = math.log(names + PRIOR_NAMES) + MARGIN

    def alike(self, a: str, b: str) -> float:
        """0, or how alike two different tokens are: two typings of one word, or an abbreviation of the other. Numbers are not."""
        if a != b and a.isdigit() and b.isdigit():
            return 0.0
        if a[0] != b[0] and 2 * min(len(a), len(b)) < ALIKE * (len(a) + len(b)) and a not in self.names and a[0].isalpha() and b[0].isalpha():
            return 0.0
        key = (a, b) if a < b else (b, a)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            found = self.seen[key] = self._alike(*key)
        return found

    def _alike(self, a: str, b: str) -> float:
        if a in self.names and b in self.names:
            return 1.0 if self.names[a] & self.names[b] else 0.0
        if not (a.isalpha() and b.isalpha()):  # digits typed for the letters they resemble
            pairs = [(a.translate(x), b.translate(x)) for x in _DIGITS]
            if pairs != [(a, b)] * len(pairs):
                return max(1.0 if x == y else self._alike(x, y) for x, y in pairs if (x, y) != (a, b))
        short, both, first = min(len(a), len(b)), len(a) + len(b), a[0] == b[0]
        of_a, of_b = set(a), set(b)
        most = min(len(a) - len(of_a - of_b), len(b) - len(of_b - of_a))  # letters that the other one lacks are lost
        if 2 * most < ALIKE * both and not (first and most == short > 1):
            return 0.0
        common = lcs(a, b)
        ratio = 2 * common / both
        return ratio if ratio >= ALIKE or first and common == short > 1 else 0.0

    def besides(self, token: str, count: int) -> float:
        """What a token without a partner tells: no more than a generic token of which it is a typing or an abbreviation."""
        if token not in self.left:
            if len(self.left) > 200_000:
                self.left.clear()
            like = [n for g, n in self.generic.items() if g[0] == token[0] and (g == token or self.alike(token, g))]
            self.left[token] = max(like, default=0)
        return weight(max(count, self.left[token]), self.n)

    def _alone(self, a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
        """Whether a has a word of which b has no typing, no initial and no part."""
        for t, _ in a:
            if len(t) > 1 and not any(u[0] == t[0] and (len(u) == 1 or len(t) > 7 or len(u) > 7) or len(u) > 1 and self.alike(t, u) for u, _ in b):
                if not any(len(u) > 7 and len(t) > 2 and u[-1] == t[-1] for u, _ in b):
                    return True
        return False

    def same(self, one: list[str], two: list[str], counts1: list[int], counts2: list[int]) -> bool:
        a, b, agreed, exact, ratios = [], list(zip(two, counts2)), 0.0, 0, []
        for t in zip(one, counts1):
            if len(t[0]) > 1 and t in b:
                b.remove(t)
                agreed += weight(t[1], self.n)
                exact += 1
            else:
                a.append(t)
        # Most candidates share a word and differ in several others: both sides then keep a word that nothing is like.
        if self._alone(a, b) and self._alone(b, a):
            return False
        for x, y in ((a, b), (b, a)):  # two words written as one
            for t in [t for t in x if len(t[0]) > 7] if len(y) > 1 else ():
                for u in [u for u in y if len(u[0]) > 2 and u[0][0] == t[0][0]]:
                    rest = len(t[0]) - len(u[0])
                    v = next((v for v in y if v is not u and len(v[0]) > 2 and -3 < len(v[0]) - rest < 3 and self.alike(t[0], u[0] + v[0]) >= 0.9), None)
                    if v:
                        x.remove(t)
                        y.remove(u)
                        y.remove(v)
                        agreed += weight(u[1], self.n) + weight(v[1], self.n)
                        exact += 1
                        break
        likes = sorted(((self.alike(s[0], t[0]), i, j) for i, s in enumerate(a) for j, t in enumerate(b) if len(s[0]) > 1 and len(t[0]) > 1), reverse=True) if a and b else ()
        used_a, used_b = set(), set()
        for like, i, j in likes:
            if like and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                agreed += like * weight(max(a[i][1], b[j][1]), self.n)
                ratios.append(like)
        a = [t for i, t in enumerate(a) if i not in used_a]
        b = [t for j, t in enumerate(b) if j not in used_b]
        stands, equal = [False, False], False
        for k, (x, y) in enumerate(((a, b), (b, a))):  # initials
            for t in [t for t in x if len(t[0]) == 1]:
                partner = next((u for u in y if u[0] == t[0]), None) or next((u for u in y if len(u[0]) > 1 and u[0][0] == t[0]), None)
                if partner:
                    x.remove(t)
                    y.remove(partner)
                    stands[k] |= len(partner[0]) > 1
                    equal |= len(partner[0]) == 1
        if a and b:
            return False
        # An initial stands for no name beside another one of its side, nor alone where the other side has a given name to it.
        for k, x in enumerate((a, b)):
            if stands[k] and any(len(t[0]) > 1 for t in x) or equal and any(t[0] in self.names for t in x):
                return False
        besides = sum(self.besides(*t) for t in (*a, *b) if len(t[0]) > 1)
        if not besides and (exact or ratios and sum(ratios) >= 0.85 * len(ratios)):
            return True
        return agreed >= self.enough and besides <= LEFT_OVER * agreed


def name_parts(tokens: list[str], names: dict[str, frozenset[str]]) -> list[tuple[int, str, bool]]:
    """(token's place, key, own): every token's suffix, and a given name's initial and the full names it can stand for."""
    out = []
    for o, t in enumerate(tokens):
        if t in names:
            out += [(o, f"={t[0]}", False), *((o, f"+{full}", False) for full in sorted(names[t]))]
        out.append((o, f"={t}" if len(t) < LEAST_TOKEN else t[-SUFFIX:], True))
    return out


class Words:
    """The different words of some names by rising length, and what the screen knows of each as arrays."""

    def __init__(self, lists: list[list[str]], names: dict[str, frozenset[str]]) -> None:
        self.wide = np.array([len(x) > LONG_NAME for x in lists])
        lists = [x[:LONG_NAME] for x in lists]
        self.words = sorted({w for x in lists for w in x}, key=lambda w: (len(w), w))
        place = {w: i for i, w in enumerate(self.words)}
        self.lists = [[place[w] for w in x] for x in lists]
        full = {n: 1 << i for i, n in enumerate(sorted({f for x in names.values() for f in x}))}  # fewer than 64
        self.known, self.longest = {n: sum(full[f] for f in x) for n, x in names.items()}, max(map(len, names))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.given = np.array([self.stands_for(w) for w in self.words], np.uint64)
        self.open = self.size > 63  # does not fit into the arrays: left to the Matcher
        self.codes, counts = _codes([w[:63] for w in self.words])
        self.first = self.codes[:, 0]
        self.letters = _bits(counts > 0) | _bits(counts > 1) << np.uint64(32)  # the second half: those that stand there twice
        self.rest = np.maximum(self.size - np.bitwise_count(self.letters), 0)  # letters beyond the second copy
        self.places = np.zeros((len(self.words), 33), np.uint64)  # where each letter stands
        for k in range(self.codes.shape[1]):
            self.places[np.arange(len(self.words)), self.codes[:, k]] |= np.uint64(1 << k)
        self.places[:, 32] = 0
        ends = np.flatnonzero(np.diff(self.size)) + 1
        self.lengths = [(int(self.size[i]), slice(i, j)) for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(self.words)])]

    def stands_for(self, word: str) -> int:
        """Bits of the full names of a given name, also of one typed with digits."""
        return self.known.get(word, 0) | self.known.get(word.translate(_DIGITS[0]), 0) | self.known.get(word.translate(_DIGITS[1]), 0)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' characters as rows of codes filled up with 32, and the counts of each code.

    a to z, digits as the letters they resemble (1, i and l are one), all else in six groups: words then seem to share
    more, never less.
    """
    text = "".join(words).translate(_DIGITS[0]).replace("l", "i")
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    flat = np.where((flat >= 97) & (flat < 123), flat - 97, 26 + flat % 6)
    sizes = np.array([len(w) for w in words])
    codes = np.full((len(words), sizes.max()), 32, np.int64)
    codes[np.arange(sizes.max()) < sizes[:, None]] = flat
    return codes, np.bincount(np.repeat(np.arange(len(words)), sizes) * 32 + flat, minlength=len(words) * 32).reshape(-1, 32)


def _bits(flags: np.ndarray) -> np.ndarray:
    return (flags * (np.uint64(1) << np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _lcs(x: Words, y: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """lcs of x's words i and y's words j."""
    order = np.argsort(-y.size[j], kind="stable")
    i, j = i[order], j[order]
    left = -np.minimum(y.size[j], 63)
    size = np.minimum(x.size[i], 63)
    full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    row, base, places = full.copy(), i * 33, x.places.ravel()
    for k in range(-int(left[0]) if len(left) else 0):
        m = np.searchsorted(left, -k)  # the words longer than k
        now = row[:m]
        hit = now & places[base[:m] + y.codes[j[:m], k]]
        row[:m] = (now + hit) | (now - hit)
    out = np.empty(len(i), np.int64)
    out[order] = size - np.bitwise_count(row & full)
    return out


def _joined(x: Words, y: Words) -> set[tuple[int, int]]:
    """(word of x, word of y) of which the first may be the second and another one of the same name written as one."""
    long = [(n, s) for n, s in x.lengths if 7 < n < 64]
    wanted = {(int(f), n + d) for n, t in long for f in set(x.first[t].tolist()) for d in (-2, -1, 0, 1, 2)}
    firsts, sizes, found = y.first.tolist(), y.size.tolist(), set()
    heads: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for places in y.lists:
        parts = [(a, u, firsts[u], sizes[u]) for a, u in enumerate(places) if 2 < sizes[u] < 64]
        for a, u, first, n in parts:
            for b, v, _, m in parts:
                if a != b and (first, n + m) in wanted:
                    heads.setdefault((first, n + m), set()).add((u, v))
    for (first, size), both in heads.items():
        both = np.array(sorted(both))
        once, twice = (y.letters[both] & np.uint64(0xFFFFFFFF)), y.letters[both] >> np.uint64(32)
        shared = once[:, 0] & once[:, 1]
        letters = (once[:, 0] | once[:, 1]) | (twice[:, 0] | twice[:, 1] | shared) << np.uint64(32)
        rest = size - np.bitwise_count(letters).astype(np.int64)
        given = np.array([y.stands_for(y.words[u] + y.words[v]) if size <= y.longest else 0 for u, v in both], np.uint64)
        for n, s in long:
            if -3 < size - n < 3:
                t = np.arange(s.start, s.stop)[x.first[s] == first]
                if len(t):
                    common = np.bitwise_count(x.letters[t, None] & letters) + np.minimum(x.rest[t, None], rest)
                    for k, m in zip(*np.nonzero((20 * common >= 9 * (n + size)) | (x.given[t, None] & given != 0))):
                        found |= {(int(t[k]), int(both[m, 0])), (int(t[k]), int(both[m, 1]))}
    return found


def partners(x: Words, y: Words) -> np.ndarray:
    """Whether Matcher.same can pair a word of x with a word of y in any names; never false where it does.

    The letters that two words share bound their common subsequence, which is then computed for those that pass.
    """
    out, found = np.zeros((len(x.words), len(y.words)), bool), []
    for n, s in x.lengths:
        short, half = np.minimum(n, y.size), ALIKE / 2 * (n + y.size)
        need = np.where(short >= half, np.ceil(half), short).astype(np.int64)
        common = np.bitwise_count(x.letters[s, None] & y.letters)
        if x.rest[s].any():
            common = common + np.minimum(x.rest[s, None], y.rest)
        i, j = np.nonzero(common >= need)
        found.append((i + s.start, j))
    i, j = (np.concatenate(z) for z in zip(*found))
    common, both = _lcs(x, y, i, j), x.size[i] + y.size[j]
    good = (2 * common >= ALIKE * both) | (common == np.minimum(x.size[i], y.size[j])) & (x.first[i] == y.first[j])
    out[i[good], j[good]] = True
    i, j = np.flatnonzero(x.given), np.flatnonzero(y.given)
    out[np.ix_(i, j)] |= x.given[i, None] & y.given[j] != 0
    for i, j in _joined(x, y):
        out[i, j] = True
    for j, i in _joined(y, x):
        out[i, j] = True
    out[x.open] = True
    out[:, y.open] = True
    return out


def _by_name(bits: np.ndarray, lists: list[list[int]], every: bool) -> np.ndarray:
    """Rows of packed bits per word, combined to one per name: any of its words or every one."""
    out = np.full((len(lists), bits.shape[1]), 255 if every else 0, np.uint8)
    sizes = np.array([len(x) for x in lists])
    for k in range(sizes.max()):
        rows = np.flatnonzero(sizes > k)
        of = bits[[lists[r][k] for r in rows]]
        out[rows] = out[rows] & of if every else out[rows] | of
    return out


def screened(x: Words, y: Words) -> np.ndarray:
    """Names by names: whether each word of the one or of the other can have a partner, without which Matcher.same refuses."""
    pairs = partners(x, y)
    sides = []
    for p, mine, other in ((pairs, x, y), (pairs.T, y, x)):
        met = np.unpackbits(_by_name(np.packbits(p.T, axis=1), other.lists, False), axis=1, count=len(mine.words))  # other names by my words
        sides.append(np.unpackbits(_by_name(np.packbits(met.T, axis=1), mine.lists, True), axis=1, count=len(other.lists)))
    return (sides[0] | sides[1].T).astype(bool) | x.wide[:, None] | y.wide


def batches_of(lists: list[list[str]], rows: list[int]) -> list[list[int]]:
    """The rows in runs whose lists hold about BATCH words."""
    out, held = [], BATCH
    for i in rows:
        if held >= BATCH:
            out.append([])
            held = 0
        out[-1].append(i)
        held += min(len(lists[i]), LONG_NAME)
    return out


def matching_names(df: DataFrame, row_id: str, name: str, refine: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((f1, f2) of normal forms that mean the same, (_row, _fid, _n) of the records): see spelling_variants."""
    rows = df.where(is_present(F.col(name).cast("string"))).select(F.col(row_id).alias("_row"), normal_form(F.col(name).cast("string")).alias("_form"))
    forms, total = cut_counting(rows.groupBy("_form").agg(F.count("*").alias("_n")).withColumn("_fid", F.monotonically_increasing_id()), n=F.sum("_n"))
    members = cut(salted_join(rows, forms, ["_form"], "_n", total["n"] or 0).drop("_form"))

    def tokenise(batches):
        for batch in batches:
            tokens = [" ".join(sorted(name_tokens(f))) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.string())], ["_fid", "_bag"])

    # Forms of the same words are the same name; each bag of words is compared once.
    split, n_forms = cut_counting(forms.select("_fid", "_form").mapInArrow(tokenise, "_fid long, _bag string").where("_bag <> ''"), n=F.count("*"))
    bags, n_names = cut_counting(split.groupBy("_bag").agg(F.count("*").alias("_m")).withColumn("_cid", F.monotonically_increasing_id()), n=F.count("*"))
    names = n_names["n"]
    placed = cut(counted_join(split, bags, ["_bag"], "_m", n_forms["n"]).select("_fid", "_cid"))

    def index(batches):
        given = given_names()
        for batch in batches:
            lists = [name_parts(b.split(" "), given) for b in batch.column(1).to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = [p for x in lists for p in x]
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(lists)), counts)))
            yield pa.RecordBatch.from_arrays([owner, pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.string()), pa.array([p[2] for p in flat], pa.bool_())], ["_cid", "_o", "_p", "_own"])

    parts, n_parts = cut_counting(bags.select("_cid", "_bag").mapInArrow(index, "_cid long, _o int, _p string, _own boolean"), n=F.count("*"))
    counts = parts.groupBy("_p").agg(F.count_distinct("_cid").alias("_n"), F.count("*").alias("_rows"))
    n, common = F.col("_n"), F.col("_n") > MOST_BLOCK
    chunks = F.ceil(n / F.lit(CHUNK)).cast("long")
    counts, size = cut_counting(counts, rare=F.sum(F.when(~common & (n > 1), n)), dealt=F.sum(F.when(common, n * chunks).when(n > 1, n)))
    numbered = cut(counted_join(parts, counts, ["_p"], "_rows", n_parts["n"]).drop("_rows"))
    own, shared = F.when(F.col("_own"), F.struct("_o", "_n")), F.when(n > 1, F.struct("_p", "_n"))
    known = numbered.groupBy("_cid").agg(F.array_sort(F.collect_list(own)).alias("_c"), F.collect_set(shared).alias("_k"))  # one name's
    words = cut(bags.select("_cid", F.split("_bag", " ").alias("_t")).join(known.select("_cid", F.col("_c._n").alias("_c"), "_k"), "_cid"))
    release(split, bags, parts, counts, numbered)
    frequent = words.select(F.explode(F.array_distinct("_t")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > F.lit(GENERIC_SHARE * names))
    generic = {r[0]: r[1] for r in frequent.collect() if len(r[0]) > 1}  # at most (words of a name) / GENERIC_SHARE

    # Names that share a key meet in cells: those of a rare key with other rare ones, those of a common one chunk against chunk. Names are
    # repeated for each cell, which for common keys is more than the input can pay for at one time; so the cells are dealt to waves.
    dealt = words.select("_cid", "_t", "_c", F.inline("_k")).withColumn("_own", F.pmod(F.xxhash64("_cid"), chunks))
    dealt = dealt.withColumn("_other", F.explode(F.when(common, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("_p"), F.lit((size["rare"] or 0) // CHUNK + 1))))))
    first, second = (F.when(common, f("_own", "_other")).otherwise(F.col("_other")) for f in (F.least, F.greatest))
    dealt = dealt.select(F.when(common, F.col("_p")).otherwise("").alias("_cell"), first.alias("_a"), second.alias("_b"), F.when(~common, F.col("_p")).alias("_p"), "_own", "_cid", "_t", "_c")
    cells, waves = ["_cell", "_a", "_b"], (size["dealt"] or 0) // max(WAVE, names) + 1

    def compare(cell):
        matcher = kept(f"name_matcher_{hash(frozenset(generic.items()))}_{names}", lambda: Matcher(generic, names))
        key, chunk = cell.column("_cell")[0].as_py(), cell.column("_a")[0].as_py()
        ids, lists, counts = (cell.column(c).to_pylist() for c in ("_cid", "_t", "_c"))
        keys, out = [{p for _, p, _ in name_parts(x, matcher.names)} for x in lists], []

        def test(key, i, j):
            i, j = sorted((i, j), key=ids.__getitem__)
            # Names that share several keys are compared under the first of them.
            if min(keys[i] & keys[j]) == key and matcher.same(lists[i], lists[j], counts[i], counts[j]):
                out.append((ids[i], ids[j]))

        if key:
            own, inside = cell.column("_own").to_pylist(), cell.column("_a")[0] == cell.column("_b")[0]
            one, two = ([(rows, Words([lists[i] for i in rows], matcher.names)) for rows in batches_of(lists, side)] for side in ([i for i, x in enumerate(own) if x == chunk], [i for i, x in enumerate(own) if x != chunk]))
            for (left, x), (right, y) in combinations_with_replacement(one, 2) if inside else product(one, two):
                may = screened(x, y)
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(may, 1) if left is right else may))):
                    test(key, left[i], right[j])
        else:
            blocks: dict[str, list[int]] = {}
            for i, p in enumerate(cell.column("_p").to_pylist()):
                blocks.setdefault(p, []).append(i)
            for p, rows in blocks.items():
                for i, j in combinations(rows, 2):
                    test(p, i, j)
        return pa.table({"c1": pa.array([x[0] for x in out], pa.int64()), "c2": pa.array([x[1] for x in out], pa.int64())})

    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, but long to compare: not to be gathered in a few tasks
    wave = lambda w: dealt.where(F.pmod(F.xxhash64(*cells), F.lit(waves)) == w)
    found = cut_parts(df.sparkSession, (wave(w).repartition(4 * spread, *cells).groupBy(*cells).applyInArrow(compare, "c1 long, c2 long") for w in range(waves)))
    release(words)
    side = lambda i: placed.select(F.col("_fid").alias(f"f{i}"), F.col("_cid").alias(f"c{i}"))
    across = found.join(side(1), "c1").join(side(2), "c2").select("f1", "f2")
    within = side(1).join(side(2), F.col("c1") == F.col("c2")).where("f1 < f2").select("f1", "f2")
    matches = cut(across.unionByName(within))
    release(found, placed)
    return matches, members.select("_row", "_fid", "_n")


def spelling_variants(df: DataFrame, row_id: str, name: str, refine: str | None = None) -> DataFrame:
    """(idx1, idx2), idx1 < idx2: records whose names mean the same person or firm while their normal forms differ.

    Distinct bags of words are blocked by the suffixes of their tokens and by their given names. All names that share a
    key are compared, however many they are: where it is common, chunk against chunk, after a screen that refuses only what
    the comparison refuses (see screened). It goes token by token by the longest-common-subsequence ratio, agreement being
    weighed by how rare the tokens are (see Matcher). Matches are then expanded to records in chunks. Missing names, texts
    without a word and addresses match nothing. `refine`, needed for common keys at one time, changes nothing.
    """
    return expand_pairs(*matching_names(df, row_id, name, refine))


def variant_links(df: DataFrame, row_id: str, name: str, refine: str | None = None) -> DataFrame:
    """(row_id, class_id, links) of every record whose name is not missing: the smallest record of its normal form, and how many
    records of other forms mean the same."""
    return form_links(*matching_names(df, row_id, name, refine)).withColumnRenamed("_row", row_id)


def form_links(matches: DataFrame, members: DataFrame) -> DataFrame:
    """(_row, class_id, links) from matching forms (f1, f2) and members (_row, _fid, _n)."""
    both = matches.select("f1", "f2").unionByName(matches.select(F.col("f2").alias("f1"), F.col("f1").alias("f2")))
    forms = cut(members.groupBy("_fid").agg(F.min("_row").alias("class_id"), F.count("*").alias("_m")))
    links = both.join(forms.select(F.col("_fid").alias("f2"), "_m"), "f2").groupBy(F.col("f1").alias("_fid")).agg(F.sum("_m").alias("links"))
    classes, total = cut_counting(forms.join(links, "_fid", "left").select("_fid", "class_id", "_m", F.coalesce("links", F.lit(0)).alias("links")), n=F.sum("_m"))
    return counted_join(members.select("_row", "_fid"), classes, ["_fid"], "_m", total["n"] or 0).select("_row", "class_id", "links")


def expand_pairs(matches: DataFrame, members: DataFrame, chunk: int = LEAST_HEAVY) -> DataFrame:
    """(idx1, idx2) of the records of matching forms (f1, f2), given members (_row, _fid, _n); each record pair once.

    A form's records are dealt to chunks, and whatever meets them is repeated for each chunk, so that the pairs of a form
    that many records share are made by as many tasks as it has chunks.
    """
    sizes = members.select("_fid", "_n").distinct()
    out = matches
    for i, f in enumerate(("f1", "f2"), 1):
        out = out.join(sizes.select(F.col("_fid").alias(f), F.col("_n").alias(f"_n{i}")), f)
    # The larger form's rows are matched last, from the smaller form's rows, each on its own.
    small = F.col("_n1") <= F.col("_n2")
    out = out.select(*[F.when(small, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("f1", "f2", "_small"), ("f2", "f1", "_large"), ("_n1", "_n2", "_ns"), ("_n2", "_n1", "_nl"))])
    chunks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / F.lit(chunk))))
    dealt = members.select("_fid", "_row", F.pmod(F.xxhash64("_row"), F.floor((F.col("_n") - 1) / F.lit(chunk)) + 1).alias("_chunk"))
    half = out.withColumn("_chunk", chunks("_ns")).join(dealt.select(F.col("_fid").alias("_small"), F.col("_row").alias("_r1"), "_chunk"), ["_small", "_chunk"])
    half = half.select("_r1", "_large", chunks("_nl").alias("_chunk"))
    pairs = half.join(dealt.select(F.col("_fid").alias("_large"), F.col("_row").alias("_r2"), "_chunk"), ["_large", "_chunk"])
    return pairs.select(F.least("_r1", "_r2").alias("idx1"), F.greatest("_r1", "_r2").alias("idx2"))
