"""Variant spellings of names typed by people.

Names are brought to a form that takes away what isn't spelling: case, punctuation, titles, legal forms, word
order, abbreviated trade words and nicknames. What remains, a person's surname or an organisation's words without
blanks, is compared by a true edit metric in an exact radius join (metric_join). Pairs it finds are checked on the
other parts: given names, initials, generation, address. Matches are consolidated into groups; a record that gives
only an initial joins a group only if it fits no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import fold, present
from siltstone.llm.groups import connected
from siltstone.llm.metric_join import radius_join
from siltstone.session import cut, release

RADIUS = 3

# Given names and what they are called for short.
NICKNAMES = """
ABIGAIL ABBY GAIL; ALEXANDER ALEX AL SANDY ALEC; ANTHONY TONY; CHARLES CHAS CHUCK CHARLIE; DANIEL DAN DANNY;
DEBORAH DEB DEBBIE; EDWARD ED EDDIE TED NED; ELIZABETH LIZ BETH BETTY ELIZA LIZZIE; FREDERICK FRED FREDDY; GREGORY GREG;
HENRY HANK HARRY; JAMES JAS JIM JIMMY; JOSEPH JOS JOE; KATHERINE KATE KATHY KAY; LAWRENCE LARRY; MARGARET MEG
MAGGIE PEGGY; MICHAEL MIKE MICK; NICHOLAS NICK; OLIVER OLLIE; PATRICIA PAT PATTY TRISH; QUENTIN QUINN; RICHARD
RICH RICK DICK; ROBERT ROB BOB BOBBY; STEPHEN STEVE; SUSAN SUE SUZY; THOMAS TOM TOMMY THOS; URSULA ULLA; VICTORIA
VICKY TORI; VIRGINIA GINNY; WILLIAM WILL BILL BILLY WM; YVONNE EVE; ZACHARY ZACK; JOHN JACK JOHNNY; GEORGE GEO;
BENJAMIN BEN; SAMUEL SAM; MATTHEW MATT; CHRISTOPHER CHRIS; ANDREW ANDY; TIMOTHY TIM; KENNETH KEN; RONALD RON;
DONALD DON; JENNIFER JENNY JEN; BARBARA BARB; DAVID DAVE; MARY MOLLY; RAYMOND RAY; WALTER WALT; PHILIP PHIL
"""
# Words of trade and how they are shortened.
TRADE_WORDS = """
SERVICES SVC SVCS SERV SERVICE; TRAINING TRNG; FLIGHT FLT; INTERNATIONAL INTL; AIRWAYS AWYS; CHARTER CHTR
CHARTERS; HOLDINGS HLDG HLDGS HOLDING; HELICOPTERS HELOS HELI HELICOPTER; AVIATION AVN AVIAT; EQUIPMENT EQPT EQUIP;
TECHNOLOGIES TECH TECHS TECHNOLOGY; AIRCRAFT ACFT AC; LEASING LSG; ENTERPRISES ENT ENTPRS ENTERPRISE; TRANSPORT TRSP
TRANS; AGRICULTURAL AG AGRI; MANAGEMENT MGMT MGT; MAINTENANCE MAINT MX; AIR; ASSOCIATES ASSOC; MANUFACTURING MFG;
INDUSTRIES IND INDS; SYSTEMS SYS; BROTHERS BROS; PROPERTIES PROP; PARTNERS PTNRS; AEROSPACE AERO; GROUP GRP
"""
LEGAL_FORMS = frozenset("LLC INC INCORPORATED CORP CORPORATION CO COMPANY LTD LIMITED LP LLP PLC GMBH AG SA JSC TRUSTEE LIABILITY".split()) - {"AG"}
TITLES = frozenset("MR MRS MS DR CAPT CAPTAIN COL MAJ LT SGT REV PROF THE".split())
GENERATIONS = {"JR": "JR", "JUNIOR": "JR", "SR": "SR", "SENIOR": "SR", "II": "II", "III": "III", "IV": "IV"}


def _table(text: str) -> dict[str, str]:
    return {w: entry.split()[0] for entry in text.split(";") for w in entry.split()}


GIVEN, TRADE = _table(NICKNAMES), _table(TRADE_WORDS)


def edit_distance(a: str, b: str, limit: int) -> int:
    """Edits between a and b, a swap of neighbours being one; limit + 1 if there are more than limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def _letters_of(word: str) -> int:
    """The set of a word's letters as bits. An edit changes at most two of them, so words whose sets differ in more
    than twice a number of letters are more edits apart."""
    bits = 0
    for ch in word:
        bits |= 1 << (ord(ch) & 63)
    return bits


class _Spellings:
    """Fixed spellings and what they stand for, with their lengths and sets of letters as arrays."""

    def __init__(self, words: dict[str, str], least: int):
        self.least, self.full, self.known = least, words, {}
        self.spelt = [w for w in words if len(w) >= least]
        self.sizes = np.array([len(w) for w in self.spelt])
        self.bits = np.array([_letters_of(w) for w in self.spelt], dtype=np.uint64)

    def nearest(self, word: str) -> str | None:
        """The entry that word is or is a misspelling of: one edit, two from eight letters on."""
        if word in self.full:
            return self.full[word]
        if len(word) < self.least:
            return None
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            limit = 1 if len(word) < 8 else 2
            likely = (np.bitwise_count(self.bits ^ np.uint64(_letters_of(word))) <= 2 * limit) & (abs(self.sizes - len(word)) <= limit)
            near = ((edit_distance(word, self.spelt[i], limit), self.full[self.spelt[i]]) for i in np.flatnonzero(likely))
            best = min(near, default=(9, ""))
            self.known[word] = best[1] if best[0] <= limit else None
        return self.known[word]


_SPELLINGS: dict[tuple[int, int], _Spellings] = {}


def _nearest(word: str, words: dict[str, str], least: int = 5) -> str | None:
    if (id(words), least) not in _SPELLINGS:
        _SPELLINGS[id(words), least] = _Spellings(words, least)
    return _SPELLINGS[id(words), least].nearest(word)


def parse_name(name: str) -> tuple[str, str, str, str, str]:
    """(kind, core, given, middle, generation). kind is 'org' or 'person'; an organisation has only a core: its
    words without blanks, trade words written out, legal forms left out. A person's core is the surname, and '?' a
    generation that the form of the name doesn't tell."""
    t = name.upper()
    t = re.sub(r"(?<=\b[A-Z])\.(?=[A-Z]\b)", "", t).replace("'", "").replace("’", "").replace("/", "").replace("&", " AND ")
    t = re.sub(r"[^A-Z0-9,ÄÖÜÉÈÊÁÀÂÍÓÔÚÑÇ]+", " ", t).strip()
    t = re.sub(r"\bL L C\b", "LLC", t)
    t = re.sub(r"\bL L P\b", "LLP", t)
    parts = [[w for w in p.split() if w not in TITLES] for p in t.split(",")]
    words = [w for p in parts for w in p]
    # the form 'Last, First' leaves the generation out; other forms give it
    generation = next((GENERATIONS[w] for w in words if w in GENERATIONS), "?" if ", " in name.strip() else "")
    legal = any(w in LEGAL_FORMS for w in words)
    parts = [[w for w in p if w not in GENERATIONS] for p in parts]
    trade = [[TRADE.get(w) for w in p] for p in parts]
    if legal or any(x for p in trade for x in p) or "AND" in words or any(len(w) >= 6 and w not in GIVEN and not _nearest(w, GIVEN) and _nearest(w, TRADE, 6) for w in words):
        plain = [[_nearest(w, TRADE, 5) or w for w in p if w not in LEGAL_FORMS and w != "AND"] for p in parts]
        plain = [p for p in plain if p]
        if len(plain) > 1 and all(w in TRADE for w in plain[0]) and not all(w in TRADE for w in plain[1]):
            plain = plain[1:] + plain[:1]
        core = [w for p in plain for w in p]
        return ("org", "".join(core) or "".join(words), "", "", "")
    parts = [p for p in parts if p]
    if not parts:
        return ("person", "", "", "", generation)
    if len(parts) > 1:
        surname, rest = parts[0], [w for p in parts[1:] for w in p]
    else:
        p = parts[0]
        if len(p) == 1:
            return ("person", p[0], "", "", generation)
        first = len(p[0]) == 1 or p[0] in GIVEN
        second = len(p[-1]) == 1 or p[1] in GIVEN or (len(p[1]) == 1 and len(p[-1]) == 1)
        if first == second and len(p[0]) > 1:
            first, second = bool(_nearest(p[0], GIVEN, 4)), bool(_nearest(p[1], GIVEN, 4))
        if first and not (second and len(p[-1]) == 1 and len(p[0]) > 1):
            surname, rest = p[-1:], p[:-1]
        else:
            surname, rest = p[:1], p[1:]
    given = rest[0] if rest else ""
    given = _nearest(given, GIVEN, 4) or given
    middle = rest[1][0] if len(rest) > 1 else ""
    return ("person", "".join(surname), given, middle, generation)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([parse_name(n) for n in batch["name"]], columns=["kind", "core", "given", "middle", "generation"])
        out.insert(0, "name", batch["name"].to_numpy())
        yield out


def parsed_names(names: DataFrame) -> DataFrame:
    """names with kind, core, given, middle and generation; each distinct name is parsed once."""
    # parsing costs more than moving a name: names are spread over all cores however few bytes they are
    spread = 4 * names.sparkSession.sparkContext.defaultParallelism
    return names.select("name").distinct().repartition(spread, "name").mapInPandas(_parse, "name string, kind string, core string, given string, middle string, generation string")


def near(a: Column, b: Column, limit: int) -> Column:
    return F.levenshtein(a, b, limit) >= 0


def same_place(a: str, b: str) -> Column:
    """Addresses agree: number and street if both have one, else postal code and city as far as given."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    street = (x("number") == y("number")) & near(x("street"), y("street"), 2)
    post = F.coalesce(x("post") == y("post"), F.lit(True))
    city = F.coalesce(near(x("city"), y("city"), 3), F.lit(True))
    told = x("post").isNotNull() & y("post").isNotNull() | x("city").isNotNull() & y("city").isNotNull()
    return F.when(x("street").isNotNull() & y("street").isNotNull(), street).otherwise(post & city & told)


def same_name(a: str, b: str) -> Column:
    """What the metric didn't compare agrees: a given name may be an initial, a middle initial may lack."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    given_x, given_y = x("given"), y("given")
    initial = (F.length(given_x) <= 1) | (F.length(given_y) <= 1)
    given = F.when(initial, F.substring(given_x, 1, 1) == F.substring(given_y, 1, 1)).otherwise((given_x == given_y) | ((F.length(given_x) >= 5) & near(given_x, given_y, 2)))
    middle = (x("middle") == y("middle")) | (x("middle") == "") | (y("middle") == "")
    limit = F.when(x("kind") == "org", F.lit(RADIUS)).otherwise(F.when(F.least(F.length(x("core")), F.length(y("core"))) >= 6, F.lit(RADIUS)).otherwise(F.lit(1)))
    return (x("kind") == y("kind")) & (F.levenshtein(x("core"), y("core")) <= limit) & F.when(x("kind") == "org", F.lit(True)).otherwise(given & middle & ((x("generation") == y("generation")) | (x("generation") == "?") | (y("generation") == "?")))


def _settled(faces: DataFrame, met: DataFrame) -> DataFrame:
    """(node, label): the group of each face, of edges met (a, b, level_a, level_b) in both directions.

    Faces of one level hold together, those of level 2 (only an initial) if they fit nothing better known. A group of
    level 1 (unknown generation), and then a face of level 2, joins the better known group that it fits, if all that it
    fits is one group."""
    fitting = met.where("level_a = 2 and level_b < 2").select("a").distinct()
    free = met.where("level_a = 2 and level_b = 2").join(fitting, "a", "left_anti").join(fitting.withColumnRenamed("a", "b"), "b", "left_anti")
    held = connected(met.where("level_a = level_b and level_a < 2").unionByName(free).select("a", "b"))
    groups = faces.select(F.col("face").alias("node")).join(held, "node", "left").select("node", F.coalesce("label", "node").alias("label"))

    def one_group(fits: DataFrame) -> DataFrame:
        """(own, joined) from (own, known): where all that is known is the same."""
        return fits.groupBy("own").agg(F.min("known").alias("joined"), F.max("known").alias("most")).where("joined = most").select("own", "joined")

    known = groups.select(F.col("node").alias("b"), F.col("label").alias("known"))
    fits = met.where("level_a = 1 and level_b = 0").join(groups.select(F.col("node").alias("a"), F.col("label").alias("own")), "a").join(known, "b")
    groups = cut(groups.join(one_group(fits).withColumnRenamed("own", "label"), "label", "left").select("node", F.coalesce("joined", "label").alias("label")))
    release(groups.sparkSession)
    known = groups.select(F.col("node").alias("b"), F.col("label").alias("known"))
    fits = met.where("level_a = 2 and level_b < 2").join(known, "b").select(F.col("a").alias("own"), "known")
    return groups.join(one_group(fits).withColumnRenamed("own", "node"), "node", "left").select("node", F.coalesce("joined", "label").alias("label"))


def link_registrants(records: DataFrame, key: str, name: str, street: str, city: str, state: str, post: str, county: str) -> DataFrame:
    """(group_id, key, name): registrants, each a person or organisation at its address.

    name is the spelling after trimming, collapsing blanks and upper-casing. Records without a name are in no
    group; a name that nothing else is tied to is a group of its own. Rows that repeat a key with the same fields
    count once. Records whose address is missing altogether are only tied to equal names of the same county.
    """
    line = F.trim(F.upper(F.regexp_replace(present(F.col(street)), r"[^\p{L}\p{N}]+", " ")))
    rows = records.select(
        F.col(key).cast("string").alias("key"),
        fold(present(F.col(name))).alias("name"),
        F.concat_ws("|", F.coalesce(fold(present(F.col(state))), F.lit("")), F.coalesce(F.trim(F.col(county)), F.lit(""))).alias("block"),
        F.regexp_extract(line, r"^\s*(\d+)", 1).alias("number"),
        F.when(line.isNotNull(), F.regexp_extract(line, r"^\s*\d*\s*(.*?)\s*(\S+)?$", 1)).alias("street"),
        F.regexp_replace(F.upper(present(F.col(city))), r"[^\p{L}]+", "").alias("city"),
        F.substring(F.trim(present(F.col(post))), 1, 5).alias("post"),
    ).where("name is not null").distinct()
    rows = rows.join(parsed_names(rows), "name")
    parts = ["block", "kind", "core", "given", "middle", "generation", "number", "street", "city", "post"]
    rows = cut(rows.withColumn("face", F.xxhash64(*[F.coalesce(F.col(p), F.lit("\0")) for p in parts])))
    release(rows.sparkSession)
    faces = rows.select("face", *parts).distinct()
    close = radius_join(faces.select("block", F.col("core").alias("s")), RADIUS).select("block", F.col("a").alias("core"), F.col("b").alias("other"))
    equal = faces.select("block", "core", F.col("core").alias("other")).distinct()
    either = close.unionByName(equal)
    x = faces.select(F.struct("face", *parts).alias("x"), "block", "core").join(either, ["block", "core"])
    met = x.select("x", "block", F.col("other").alias("core")).join(faces.select(F.struct("face", *parts).alias("y"), "block", "core"), ["block", "core"])
    met = met.where((F.col("x.face") != F.col("y.face")) & same_name("x", "y") & same_place("x", "y"))
    # 0: a full given name and a known generation, 1: an unknown generation, 2: only an initial
    level = lambda s: F.when(F.col(f"{s}.kind") == "org", 0).when(F.length(f"{s}.given") <= 1, 2).when(F.col(f"{s}.generation") == "?", 1).otherwise(0)
    met = met.select(F.col("x.face").alias("a"), F.col("y.face").alias("b"), level("x").alias("level_a"), level("y").alias("level_b"))
    met = cut(met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("level_b").alias("level_a"), F.col("level_a").alias("level_b"))).distinct())
    release(rows.sparkSession)
    found = rows.select("key", "name", F.col("face").alias("node")).join(_settled(faces, met), "node")
    return found.select(F.col("label").alias("group_id"), "key", "name").distinct()


def variant_pairs(groups: DataFrame, largest: int = 2000) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the keys of a group whose names differ, all such pairs.

    They are built between the spellings of a group, each with its keys. Spellings with more keys than largest are dealt
    out in parts that meet each other once, so no task holds a hot group or emits all its pairs."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    rows = groups.join(sizes, "group_id").withColumn("parts", F.ceil(F.col("n") / largest).cast("int"))
    mine = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = rows.select("group_id", F.col("key").alias("key_a"), F.col("name").alias("a"), mine.alias("i"), each.alias("j"))
    b = rows.select("group_id", F.col("key").alias("key_b"), F.col("name").alias("b"), mine.alias("j"), each.alias("i"))
    return a.join(b, ["group_id", "i", "j"]).where("key_a < key_b and a <> b").select("key_a", "key_b").distinct()


# How a model's edition and number are written.
EDITIONS = {"pro": "pro", "prof": "pro", "professional": "pro", "mini": "mini", "min": "mini", "mn": "mini", "lite": "lite", "light": "lite", "lt": "lite", "ultra": "ultra", "ult": "ultra", "max": "max", "plus": "plus"}
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {w: i + 1 for i, w in enumerate("i ii iii iv v vi vii viii ix x xi xii".split())}
FILLERS = frozenset("main assy assembly gen generation model the".split())


def parse_model(description: str) -> tuple[str | None, str | None]:
    """(the model's number and edition, the word for its family) of a description, or nulls if it has no such parts."""
    t = re.sub(r"\(.*?\)", " ", description.lower())
    words = [w for w in re.findall(r"[^\W\d_]+|\d+", t) if w not in FILLERS]
    number, edition, family = None, "", []
    for w in words:
        if w.isdigit() or w in NUMBERS:
            if number is not None:
                return (None, None)
            number = int(w) if w.isdigit() else NUMBERS[w]
        elif w in EDITIONS or _nearest(w, EDITIONS):
            if edition:
                return (None, None)
            edition = EDITIONS.get(w) or _nearest(w, EDITIONS)
        else:
            family.append(w)
    return (f"{number}|{edition}", family[0]) if number is not None and len(family) == 1 else (None, None)


def _parse_models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([parse_model(n) for n in batch["name"]], columns=["block", "family"])
        out.insert(0, "name", batch["name"].to_numpy())
        yield out


def link_models(descriptions: DataFrame, models: DataFrame, radius: int = 2) -> DataFrame:
    """(name, model): the one model that each description means.

    descriptions: name. models: name, model. Number and edition must agree; the family's word is the nearest within
    radius, or an abbreviation of three to five letters that fits one family only. Descriptions that two models
    are equally near to mean none. Null names, and models without a number, take no part.
    """
    schema = "name string, block string, family string"
    said = descriptions.select("name").where("name is not null").distinct().mapInPandas(_parse_models, schema).where("block is not null")
    known = models.where("name is not null and model is not null").distinct()
    known = known.join(known.select("name").distinct().mapInPandas(_parse_models, schema), "name").where("block is not null").select("block", "family", "model").distinct()
    families = known.select("family").distinct()
    short = families.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(5)), lambda n: F.substring("family", F.lit(1), n))).alias("said"), "family").distinct()
    short = short.groupBy("said").agg(F.min("family").alias("full"), F.count(F.lit(1)).alias("n")).where("n = 1").select("said", "full")
    said = said.withColumnRenamed("family", "said").join(short, "said", "left").select("name", "block", F.coalesce("full", "said").alias("said"))
    said = cut(said)
    release(said.sparkSession)
    close = radius_join(said.select("block", F.col("said").alias("s")).unionByName(known.select("block", F.col("family").alias("s"))), radius)
    both = close.unionByName(close.select("block", F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    same = said.select("block", F.col("said").alias("a"), F.col("said").alias("b"), F.lit(0).alias("distance")).distinct()
    met = both.unionByName(same).join(known.select("block", F.col("family").alias("b"), "model"), ["block", "b"])
    best = met.groupBy("block", "a").agg(F.min(F.struct("distance", "model")).alias("first"), F.collect_set(F.struct("distance", "model")).alias("all"))
    sure = best.where(F.size(F.filter("all", lambda m: m["distance"] == F.col("first.distance"))) == 1)
    return said.join(sure.select("block", F.col("a").alias("said"), F.col("first.model").alias("model")), ["block", "said"]).select("name", "model")
