"""Same location, differently written: a gazetteer built from the addresses themselves."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import is_present, normal_form
from kinweave.llm.names import expand_pairs, form_links, lcs
from kinweave.llm.worker import kept
from kinweave.operators.skew import counted_join, salted_join
from kinweave.session import cut, cut_counting

ALIKE = 0.78
LEAST_SCORE = 1.0  # of a locality that an address may mean
SLACK = 0.4  # readings and localities whose score comes so near the best one's stay in the search
KNOWN_STREET = 0.4  # what a street that other addresses name in a locality adds to the score

# Postal abbreviations.
STATES = """
alabama al, alaska ak, arizona az, arkansas ar, california ca, colorado co, connecticut ct, delaware de, florida fl, georgia ga, hawaii hi, idaho id,
illinois il, indiana in, iowa ia, kansas ks, kentucky ky, louisiana la, maine me, maryland md, massachusetts ma, michigan mi, minnesota mn,
mississippi ms, missouri mo, montana mt, nebraska ne, nevada nv, new hampshire nh, new jersey nj, new mexico nm, new york ny, north carolina nc,
north dakota nd, ohio oh, oklahoma ok, oregon or, pennsylvania pa, rhode island ri, south carolina sc, south dakota sd, tennessee tn, texas tx,
utah ut, vermont vt, virginia va, washington wa, west virginia wv, wisconsin wi, wyoming wy, district of columbia dc
"""
KINDS = """
street: str st; avenue: ave av aven; boulevard: blvd boul blv; drive: dr drv; lane: ln la; road: rd; court: ct crt; place: pl plc; terrace: ter terr;
parkway: pkwy pky pkway; highway: hwy hgwy hiway; circle: cir; square: sq; trail: trl; way: wy; alley: aly; loop: lp
"""
DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw"}
UNITS = "apartment apt unit un suite ste floor flr fl room rm no number".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()

_STATE = {part: pair.split()[-1] for pair in STATES.replace("\n", " ").split(",") for part in (" ".join(pair.split()[:-1]), pair.split()[-1])}
_STATE_NAMES = {k: v for k, v in _STATE.items() if len(k) > 3}
_KIND = {w: e.partition(":")[0].strip() for e in KINDS.replace("\n", " ").split(";") for w in e.replace(":", " ").split()}
_DIRECTION = {**DIRECTIONS, **{v: v for v in DIRECTIONS.values()}}
_ORDINAL = {w: i for i, w in enumerate(ORDINALS, 1)}
_ORDINAL_NAMES = {w: f"#{i}" for w, i in _ORDINAL.items()}
_NTH = re.compile(r"(\d+)(?:st|nd|rd|th)$")
_UNIT = re.compile(r"\d{1,4}[a-z]?$|[a-z]\d{0,3}$")
_BOX = re.compile(r"\b(?:(?:p ?o|post office) )?box (\d\w*)")
_COUNTRY = re.compile(r"\b(?:united states(?: of america)?|usa|us)$")
_LETTERS = str.maketrans("015", "ols")


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def tidy(word: str) -> str:
    """Digits typed for letters inside a word become letters; numbers and ordinals stay."""
    return word.translate(_LETTERS) if any(c.isdigit() for c in word) and not word[0].isdigit() and sum(c.isalpha() for c in word) > 2 else word


def near(word: str, known: dict[str, str]) -> str | None:
    """The known long word that a word is a typing of."""
    if len(word) < 4 or any(c.isdigit() for c in word):
        return None
    cache = kept("near_words", dict).setdefault(id(known), {})  # the tables are constants of this module
    if word not in cache:
        if len(cache) > 200_000:
            cache.clear()
        best, letters = (0.0, ""), set(word)
        for k in known:
            both = len(k) + len(word)
            if len(k) > 3 and 2 * min(len(k) - len(set(k) - letters), len(word) - len(letters - set(k))) >= 0.8 * both:
                best = max(best, (ratio(word, k), k))
        cache[word] = known[best[1]] if best[0] >= 0.8 else None
    return cache[word]


def street_key(words: list[str]) -> str:
    """Core words of a street without spaces; ordinals as numbers, also slightly mistyped ones."""
    out = []
    for w in words:
        m = _NTH.match(w)
        if m:
            out.append(f"#{int(m.group(1))}")
        elif len(words) == 1 and w in _ORDINAL:
            out.append(f"#{_ORDINAL[w]}")
        elif len(words) == 1 and len(w) > 4 and w[-1] in "htd" and (o := near(w, _ORDINAL_NAMES)):
            out.append(o)
        else:
            out.append(w)
    return "".join(out)


class Reading:
    """One interpretation: what is a number, a unit, a street and a place. zip is 5 digits or empty."""

    __slots__ = ("number", "unit", "core", "kind", "direction", "city", "state", "zip", "score")

    def __init__(self, number, unit, core, kind, direction, city, state, zip_, score=0.0):
        self.number, self.unit, self.core, self.kind, self.direction, self.city, self.state, self.zip, self.score = number, unit, core, kind, direction, city, state, zip_, score


def readings(form: str) -> list[Reading]:
    """The grammatical interpretations of a normal form; none without a house or box number."""
    text = _COUNTRY.sub("", form).strip()
    box = _BOX.search(text)
    words = [tidy(w) for w in ((text[: box.start()] + " \x00 " + text[box.end() :]) if box else text).split()]
    unit = ""
    # State names of two words become one token.
    i, merged = 0, []
    while i < len(words):
        two = " ".join(words[i : i + 2])
        if " " in two and two in _STATE:
            merged.append(two)
            i += 2
        else:
            merged.append(words[i])
            i += 1
    words = merged
    out, i = [], 0
    marked = None
    while i < len(words):
        w, following = words[i], words[i + 1] if i + 1 < len(words) else ""
        if w in ("no", "number") and following.isdigit() and len(following) <= 6:
            marked = following
            out.append(following)
            i += 2
            continue
        if w in UNITS and w not in ("no", "number") and _UNIT.match(following) and (w != "fl" or len(following) < 5):
            unit = following.lstrip("0") or following
            i += 2
            continue
        out.append(w)
        i += 1
    words = out
    found: list[Reading] = []
    numbers = [i for i, w in enumerate(words) if w.isdigit()]
    after_state = [i for i in numbers if len(words[i]) == 5 and i and words[i - 1] in _STATE]
    if len(after_state) == 1 and (box or len([i for i in numbers if len(words[i]) <= 6]) > 1):
        sure = after_state[0]
    else:
        sure = None
    choices: list[int | None] = [None] if box else [i for i in numbers if i != sure and len(words[i]) <= 6 and (marked is None or words[i] == marked)]
    for at in choices:
        others = [i for i in numbers if i != at]
        zips: list[int | None] = [sure] if sure is not None else [i for i in others if len(words[i]) == 5] or [None]
        for z in zips:
            rest = [i for i in others if i != z and not (z is not None and i == z + 1 and len(words[i]) == 4)]
            spare = unit
            if rest and not spare and len(rest) == 1 and len(words[rest[0]]) < 5:
                spare, rest = words[rest[0]], []
            if len(rest) > 0:
                continue
            zip_ = words[z] if z is not None else ""
            skip = {at, *others}
            number = box.group(1) if box else words[at]
            found += _segments([(i, w) for i, w in enumerate(words) if i not in skip], words.index("\x00") if box else at, number, spare, zip_, bool(box))
    return found


def _segments(words: list[tuple[int, str]], at: int, number: str, unit: str, zip_: str, box: bool) -> list[Reading]:
    """Split the remaining words into street and place."""
    state, names = "", []
    for i, w in reversed(words):
        known = _STATE.get(w) or (len(w) > 5 and w not in _KIND and near(w, _STATE_NAMES))
        if known and not state and not (w in _KIND and len(w) == 2 and w not in ("ct", "la")):
            state = known
        else:
            names.append((i, w))
    names.reverse()
    if box:
        city = "".join(w for _, w in names if w != "\x00")
        return [Reading(number, unit, "pobox", "", "", city, state, zip_)]
    out = []
    # A street runs up to its kind word; what stands behind, or in front of the number, is the place.
    ends = [j for j, (_, w) in enumerate(names) if w in _KIND or near(w, _KIND)]
    for j in ends or [None]:
        if j is None:
            for k in range(1, len(names) + 1):  # no kind: any split
                for a, b in ((names[:k], names[k:]), (names[k:], names[:k])):
                    if a:
                        out.append(_build(a, "", b, number, unit, state, zip_, -0.5))
            continue
        kind = _KIND.get(names[j][1]) or near(names[j][1], _KIND) or ""
        before, after = names[:j], names[j + 1 :]
        if before and before[0][0] < at < names[j][0]:  # the place came first
            place = [x for x in before if x[0] < at] + after
            core = [x for x in before if x[0] > at]
            out.append(_build(core, kind, place, number, unit, state, zip_, 0.0))
            continue
        for k in range(len(before)):
            out.append(_build(before[k:], kind, before[:k] + after, number, unit, state, zip_, -0.1 * k))
        if not before:
            out.append(_build([], kind, after, number, unit, state, zip_, -0.3))
    return out


def _build(core, kind, place, number, unit, state, zip_, score) -> Reading:
    street, direction = [w for _, w in core], ""
    if len(street) > 1 and street[0] in _DIRECTION:
        direction, street = _DIRECTION[street[0]], street[1:]
    elif len(street) > 1 and street[-1] in _DIRECTION and not kind:
        direction, street = _DIRECTION[street[-1]], street[:-1]
    city = [w for _, w in place]
    if city and city[0] in _DIRECTION and kind and not direction and len(city) > 1:
        direction, city = _DIRECTION[city[0]], city[1:]
    elif len(city) == 1 and city[0] in _DIRECTION and kind and not direction:
        direction, city = _DIRECTION[city[0]], []
    if street and len(street) == 1 and street[0] in DIRECTIONS.values():
        street = [next(k for k, v in DIRECTIONS.items() if v == street[0])]
    return Reading(number, unit, street_key(street), kind, direction, "".join(city), state, zip_, score)


class Places:
    """Localities by zip and by name: at most one per zip, hence at most 100,000."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.by_zip = {z: (c, s) for z, c, s in rows}
        self.by_city: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.typed: dict[str, set[str]] = defaultdict(set)
        for z, c, s in rows:
            self.by_city[c].append((z, s))
        for c in self.by_city:
            for x in self.deletions(c):
                self.typed[x].add(c)
        self.cache: dict[str, list[tuple[float, str]]] = {}
        self.found: dict[tuple[str, str, str], list[tuple[float, str]]] = {}

    @staticmethod
    def deletions(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

    def cities(self, name: str) -> list[tuple[float, str]]:
        """Known place names with how well a name agrees, up to two typing slips."""
        if name not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            if name in self.by_city:
                self.cache[name] = [(1.0, name)]
            else:
                near_by = {c for x in self.deletions(name) for c in self.typed.get(x, ())}
                if not near_by and len(name) > 6:
                    near_by = {c for x in self.deletions(name) for y in self.deletions(x) for c in self.typed.get(y, ())}
                scored = sorted(((ratio(name, c), c) for c in near_by), reverse=True)
                self.cache[name] = [x for x in scored if x[0] >= ALIKE]
        return self.cache[name]

    def localities(self, city: str, state: str, zip_: str) -> list[tuple[float, str]]:
        """All localities that a place as written may mean, each with a score: `z` and a zip, or `c`, a city and a state.

        A city stands for all its zips. A zip that contradicts the city gives way to it, one that nobody else names does not
        exclude it. A place that is not in the gazetteer means itself.
        """
        key = (city, state, zip_)
        if key not in self.found:
            if len(self.found) > 200_000:
                self.found.clear()
            out, less = [], 0.0
            if zip_ in self.by_zip:
                known, its = self.by_zip[zip_]
                agree = ratio(city, known) if city else 0.6
                out.append((2.0 + (agree if agree >= 0.6 else -2.0 * (1 - agree)) + (0.3 if state == its else -0.5 if state else 0.0), f"z{zip_}"))
                less = None if agree >= 0.6 else 1.0
            elif zip_:
                out.append((1.4, f"z{zip_}"))
                less = 1.0
            if city and less is not None:
                for agree, name in self.cities(city):
                    out += [(1.0 + agree + (0.5 if s == state else -1.5 if state else 0.0) - less, f"c{name}|{s}") for s in sorted({s for _, s in self.by_city[name]})]
            out = [x for x in out if x[0] >= LEAST_SCORE]
            if not out and city:
                out.append((LEAST_SCORE, f"c{city}|{state}"))
            self.found[key] = out
        return self.found[key]


def gazetteer_places(parsed: DataFrame) -> list[tuple[str, str, str]]:
    """(zip, city, state): for each zip the place name most addresses give it. At most 100,000 rows, as zips have 5 digits."""
    whole = parsed.where("zip <> '' AND state <> '' AND length(city) > 2 AND _only").select("_fid", "_n", "zip", "city", "state").distinct()
    known = whole.groupBy("zip", "city", "state").agg(F.sum("_n").alias("_m"))
    best = known.groupBy("zip").agg(F.max_by(F.struct("city", "state"), F.struct("_m", "city")).alias("b"))
    return [(r[0], r[1], r[2]) for r in best.select("zip", "b.city", "b.state").collect()]


def street_ids(streets: DataFrame) -> DataFrame:
    """(place, core, street): spellings (place, core, _m) clustered within their place.

    Two spellings are close if they agree after deleting one letter from either or both. Each points to the most central
    close spelling, its own frequency counting thrice and its close ones' once (ties: the alphabetically last), and
    pointers are followed to their end. Ordinals and spellings of fewer than four letters stay alone. Deletion keys make this
    an equi-join within the place, never a comparison of all its streets; so few spellings can share one (an added
    letter each) that they are gathered.
    """
    letters = F.transform(F.sequence(F.lit(1), F.length("core")), lambda i: F.concat(F.substring("core", F.lit(1), i - 1), F.substring("core", i + 1, F.length("core"))))
    fuzzy = (F.length("core") > 3) & ~F.contains("core", F.lit("#"))
    keyed = streets.where(fuzzy).select("place", "core", "_m", F.explode(F.array_distinct(F.array_append(letters, F.col("core")))).alias("_d"))
    shared = keyed.groupBy(F.xxhash64("place", "_d").alias("_k")).agg(F.collect_list(F.struct("place", "core", "_m")).alias("_g")).where("size(_g) > 1")
    near = cut(shared.select("_k", F.aggregate("_g", F.lit(0.0), lambda n, x: n + x["_m"]).alias("_s"), F.inline("_g")))
    central = near.groupBy("place", "core").agg((3 * F.first("_m") + F.sum(F.col("_s") - F.col("_m"))).alias("_c"))
    ranked = cut(near.select("_k", "place", "core").join(central, ["place", "core"]))
    up = ranked.join(ranked.groupBy("_k").agg(F.max(F.struct("_c", "core")).alias("_b")), "_k").groupBy("place", "core").agg(F.max("_b").alias("_b"))
    moves, seen = cut_counting(up.where("_b.core <> core").select("place", "core", F.col("_b.core").alias("street")), open=F.count("*"))
    while seen["open"]:
        above = moves.select("place", F.col("core").alias("street"), F.col("street").alias("_up"))
        step = moves.join(above, ["place", "street"], "left").select("place", "core", F.coalesce("_up", "street").alias("street"), F.col("_up").isNotNull().alias("_open"))
        moves, seen = cut_counting(step, open=F.count_if("_open"))
        moves = moves.drop("_open")
    return streets.join(moves, ["place", "core"], "left").select("place", "core", F.coalesce("street", "core").alias("street"))


def _streets(found: DataFrame, known: list[tuple[str, str, str]]) -> DataFrame:
    """(place, core, _rows, sid, _all): the street identifiers that a spelling may mean in a place, and how many addresses name each.

    Spellings are clustered within a locality, all its zips and the addresses without zip together, so that a spelling used
    without zip can connect others. The gazetteer's entries are these clusters by zip. A city means the entries of all
    its zips; a cluster that none of them has is an entry of the city.
    """
    cores = cut(found.groupBy("place", "core").agg(F.sum(F.when(F.col("_top"), F.col("_share")).otherwise(0.0)).alias("_m"), F.count("*").alias("_rows")))
    towns = F.broadcast(found.sparkSession.createDataFrame([(f"z{z}", f"c{c}|{s}") for z, c, s in known], "place string, _town string"))  # at most 100,000 rows
    spelled = cut(cores.join(towns, "place", "left").withColumn("_town", F.coalesce("_town", "place")))
    groups = street_ids(cut(spelled.groupBy(F.col("_town").alias("place"), "core").agg(F.sum("_m").alias("_m"))))
    named = cut(spelled.join(groups.select(F.col("place").alias("_town"), "core", F.col("street").alias("_g")), ["_town", "core"]))
    entries = named.where(F.col("place").startswith("z")).groupBy("_town", "place", "_g").agg(F.sum("_m").alias("_all"))
    entries = cut(entries.select("_town", F.col("place").alias("_zip"), "_g", "_all"))
    sid = lambda place: F.concat(F.col(place), F.lit(" "), F.col("_g"))
    in_zip = named.where(F.col("place").startswith("z")).join(entries.select(F.col("_zip").alias("place"), "_g", "_all"), ["place", "_g"])
    in_city = named.where(F.col("place").startswith("c")).join(entries, ["_town", "_g"], "left")
    by_zip = in_zip.select("place", "core", "_rows", sid("place").alias("sid"), "_all")
    return cut(by_zip.unionByName(in_city.select("place", "core", "_rows", F.coalesce(sid("_zip"), sid("place")).alias("sid"), F.coalesce("_all", F.lit(0.0)).alias("_all"))))


def matching_locations(df: DataFrame, row_id: str, address: str) -> tuple[DataFrame, DataFrame]:
    """((f1, f2) of normal forms that denote one location, (_row, _fid, _n) of the records): see same_locations."""
    rows = df.where(is_present(F.col(address).cast("string"))).select(F.col(row_id).alias("_row"), normal_form(F.col(address).cast("string")).alias("_form"))
    forms, total = cut_counting(rows.groupBy("_form").agg(F.count("*").alias("_n")).withColumn("_fid", F.monotonically_increasing_id()), n=F.sum("_n"))
    members = cut(salted_join(rows, forms, ["_form"], "_n", total["n"] or 0).select("_row", "_fid", "_n"))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = ["number", "unit", "core", "kind", "direction", "city", "state", "zip"]

    def read(batches):
        for batch in batches:
            at, columns, scores, only = [], [[] for _ in texts], [], []
            for i, form in enumerate(batch.column(1).to_pylist()):
                options = readings(form)
                top = max((r.score for r in options), default=0.0)
                single = len({(r.zip, r.city, r.state) for r in options if r.score == top}) == 1
                for r in options:
                    at.append(i)
                    for column, name in zip(columns, texts):
                        column.append(getattr(r, name))
                    scores.append(r.score)
                    only.append(single and r.score == top)
            ids = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(2).take(ids), *[pa.array(c, pa.string()) for c in columns], pa.array(scores, pa.float64()), pa.array(only, pa.bool_())], ["_fid", "_n", *texts, "score", "_only"])

    parsed = cut(forms.select("_fid", "_form", "_n").repartition(spread).mapInArrow(read, f"_fid long, _n long, {', '.join(f'{c} string' for c in texts)}, score double, _only boolean"))
    known = gazetteer_places(parsed)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def locate(batches):
        places = kept(f"places_{hash(tuple(shared.value))}", lambda: Places(shared.value))
        for batch in batches:
            at, names, scores = [], [], []
            for i, (core, city, state, zip_, score) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("core", "city", "state", "zip", "score")))):
                if core:
                    for more, place in places.localities(city, state, zip_):
                        at.append(i)
                        names.append(place)
                        scores.append(score + more)
            ids = pa.array(at, pa.int64())
            kept_columns = ["_fid", "_n", "number", "unit", "core", "kind", "direction"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(ids) for c in kept_columns], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept_columns, "place", "score"])

    located = parsed.drop("_only").mapInArrow(locate, "_fid long, _n long, number string, unit string, core string, kind string, direction string, place string, score double")
    best = Window.partitionBy("_fid")  # one address's readings
    beam = located.withColumn("_best", F.max("score").over(best)).where(F.col("score") >= F.col("_best") - SLACK - KNOWN_STREET)
    beam = beam.withColumn("_top", F.col("score") == F.col("_best")).withColumn("_share", F.col("_n") / F.count_if("_top").over(best))
    found, n_found = cut_counting(beam.drop("_best"), n=F.count("*"))
    ways = counted_join(found, _streets(found, known), ["place", "core"], "_rows", n_found["n"])
    others = F.col("_all") - F.when(F.col("_top") & F.col("place").startswith("z"), F.col("_share")).otherwise(0.0)
    scored = ways.withColumn("score", F.col("score") + F.when(others >= 0.5, KNOWN_STREET).otherwise(0.0))
    resolved = scored.withColumn("_best", F.max("score").over(best)).where(F.col("score") >= F.col("_best") - SLACK)
    placed = cut(resolved.select("_fid", "sid", "number", "kind", "direction", "unit").distinct())
    side = lambda i: placed.select("sid", "number", *[F.col(c).alias(f"{c}{i}") for c in ("_fid", "kind", "direction", "unit")])
    free = lambda c: (F.col(f"{c}1") == F.col(f"{c}2")) | (F.col(f"{c}1") == "") | (F.col(f"{c}2") == "")
    agree = free("kind") & free("direction") & (F.col("_fid1") != F.col("_fid2"))
    # A unit is part of the key; an address without one stands for any.
    equal = side(1).where("unit1 <> ''").withColumnRenamed("unit1", "unit").join(side(2).withColumnRenamed("unit2", "unit"), ["sid", "number", "unit"])
    blank = side(1).where("unit1 = ''").join(side(2), ["sid", "number"])
    ends = [F.least("_fid1", "_fid2").alias("f1"), F.greatest("_fid1", "_fid2").alias("f2")]
    return cut(equal.where(agree).select(*ends).unionByName(blank.where(agree).select(*ends)).distinct()), members


def same_locations(df: DataFrame, row_id: str, address: str) -> DataFrame:
    """(idx1, idx2), idx1 < idx2: records whose addresses denote the same location while their normal forms differ.

    Distinct normal forms are read into number, unit, street and place, in every way their grammar allows. Readings that name zip,
    state and place give the gazetteer's localities, and the streets in them, whose spellings are clustered, its
    entries. A search extends every reading by the localities it may mean and these by the streets that they have,
    and keeps what comes near the best, however much it is: an address without zip is looked up in all zips of its
    city, and its street decides among them. Addresses are joined on street identifier, number and unit; one without
    unit joins any. Directions and kinds of street must not contradict each other; any may be missing. Matches are
    expanded to records in chunks. Missing values and texts without a number match nothing; places and streets that no
    complete address names match only their own spellings.
    """
    return expand_pairs(*matching_locations(df, row_id, address))


def location_links(df: DataFrame, row_id: str, address: str) -> DataFrame:
    """(row_id, class_id, links) of every record whose address is not missing: the smallest record of its normal form, and how many
    records of other forms denote its location."""
    return form_links(*matching_locations(df, row_id, address)).withColumnRenamed("_row", row_id)
