"""Per-document text quality statistics.

Documents longer than CHUNK characters are cut into chunks, in one pass over the text, and the chunks are spread over
all tasks. Each chunk gives partial counts that can be merged in any grouping: sums over its complete lines, and the
open lines at its two ends as states of their own. What a chunk can't tell alone is corrected at the border: a word
belongs to the chunk in which it begins (chunks carry one character before and LOOK_AHEAD after them), a line's kind is
settled once its parts are merged. Partial counts are merged in a tree, FAN chunks at a time, until each document
has one; ratios and rule outcomes come last. A document of one chunk is counted the same way, without a border.

Counting works on arrays of characters: classes come from a table, sums of lines from running sums, and words are
compared with the common ones by rolling hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut

CHUNK = 8192
LOOK_AHEAD = 64
FAN = 32
#: Characters counted at a time.
BLOCK = 1 << 20

# Common words of English, German, French and Spanish.
COMMON_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    one you were all her she there would their we him been has when who will no more if out so up said what its about
    than into them only other time new some could these two may first then do any like my now over such our me even
    most made after also did many off before must well back through where your way down should because each those how
    own between being under never same another while us since against again came himself few during without until
    once every does yet why both still very just i can
    der die das und zu den mit von für auf ist im dem nicht ein eine auch es werden aus er hat dass sie nach wird bei
    einer um am sind noch wie einem über einen zum war haben nur oder aber vor zur bis mehr durch man dann wurde sein
    wir ich uns ihr ihre wenn kann unter gegen vom wieder schon keine mir bitte
    le la les de des du un une et est en que qui dans pour pas sur au aux avec ce il elle sont par plus ne se sa son
    ses nous vous ils ont été être cette mais ou où si leur dont après sans peut nos notre votre était avait donc
    el los las del y por con para no su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre
    también hasta hay desde todo nos durante era fue ser son había está así
    """.split()
)
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœ"
_CLASSES = [("separator", "|;\t<>"), ("closer", "\"'”’»)] \t\r\n\x0b\x0c\u00a0"), ("ending", ".?!…"), ("bullet", "-*+•–·▪")]
SPACE, LETTER, VOWEL, DIGIT, SEPARATOR, CLOSER, ENDING, BULLET = (1 << i for i in range(8))

# a fragment of a line: sums, whether its first visible characters mark a list item, and its last telling character
SUMS = ["visible", "letters", "vowels", "digits", "separators", "words", "common"]
V, L, W_, D, S, N, C = range(7)
TOTALS = [*SUMS, "lines", "lines_ended", "list_lines", "prose"]


class _Characters:
    """The classes and the lower case of characters, looked up once for each character that occurs."""

    def __init__(self):
        self.known = np.zeros(0x110000, dtype=bool)
        self.kind = np.zeros(0x110000, dtype=np.uint8)
        self.lower = np.zeros(0x110000, dtype=np.uint64)

    def learn(self, codes: np.ndarray) -> None:
        new = codes[~self.known[codes]]
        for code in np.unique(new) if len(new) else ():
            ch = chr(code)
            kind = SPACE * ch.isspace() | LETTER * (ch.isalnum() and not ch.isdecimal()) | DIGIT * ch.isdecimal()
            kind |= VOWEL * (bool(kind & LETTER) and ch.lower() in VOWELS)
            for flag, (_, members) in zip((SEPARATOR, CLOSER, ENDING, BULLET), _CLASSES, strict=True):
                kind |= flag * (ch in members)
            self.kind[code], self.lower[code], self.known[code] = kind, ord(ch.lower()[0]), True


class _Hashes:
    """Hashes of all stretches of a text from running sums of character * BASE^place, modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: frozenset):
        self.grow(1024)
        self.words = np.array([], dtype=np.uint64)
        spelt = sorted(words)
        if spelt:
            codes = np.array([ord(c) for w in spelt for c in w], dtype=np.uint64)
            ends = np.cumsum([len(w) for w in spelt])
            self.words = np.unique(self.of(codes, ends - [len(w) for w in spelt], ends))

    def grow(self, n: int) -> None:
        powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)], dtype=np.uint64)
        self.up, self.down = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def of(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(codes) >= len(self.up):
            self.grow(2 * len(codes))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * self.up[: len(codes)], dtype=np.uint64)])
        return (sums[ends] - sums[begins]) * self.down[begins]

    def common(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(self.words) or not len(begins):
            return np.zeros(len(begins), dtype=bool)
        h = self.of(codes, begins, ends)
        return self.words[np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)] == h


_characters = _Characters()
_hashes: dict[frozenset, _Hashes] = {}


def _list_items(codes: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a list item begins at each place first: a bullet, a number or letter with '.' or ')', or a box, and
    then a blank. codes and kind reach at least eight characters beyond."""
    char = lambda at, c: codes[at] == ord(c)
    blank = lambda at: (kind[at] & SPACE) > 0
    digit = lambda at: (kind[at] & DIGIT) > 0
    bullet = ((kind[first] & BULLET) > 0) & blank(first + 1)
    at = first + char(first, "(")
    places = digit(at).astype(np.int64)
    places += (places == 1) & digit(at + 1)
    places += (places == 2) & digit(at + 2)
    number = (places > 0) & (char(at + places, ".") | char(at + places, ")")) & blank(at + places + 1)
    small = codes[at] | 32
    letter = (small >= ord("a")) & (small <= ord("z")) & char(at + 1, ")") & blank(at + 2)
    box = char(first, "[") & ((char(first + 1, "]") & blank(first + 2)) | (char(first + 2, "]") & ~char(first + 1, "\n") & blank(first + 3)))
    return bullet | number | letter | box


def _fragments(pieces: list[tuple[str, str, str]], words: frozenset = COMMON_WORDS) -> tuple:
    """The parts of lines of pieces (before, chunk, after), in order: (piece, sums, item, last, ended). last is the last
    character that closes nothing, 0 if there is none."""
    texts = [b + c + a for b, c, a in pieces]
    codes = np.frombuffer(("\0".join(texts) + "\0" * 16).encode("utf-32-le"), dtype=np.uint32)
    _characters.learn(codes)
    kind = _characters.kind[codes]
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    begins = offsets + [len(b) for b, _, _ in pieces]
    ends = begins + [len(c) for _, c, _ in pieces]
    breaks = np.flatnonzero(codes == 10)
    of = np.searchsorted(begins, breaks, "right") - 1
    breaks = breaks[(of >= 0) & (breaks < ends[np.maximum(of, 0)])]
    # lines run from the begin of a piece or behind a break up to the next break or the piece's end
    start, stop = np.sort(np.r_[begins, breaks + 1]), np.sort(np.r_[ends, breaks])
    piece = np.searchsorted(begins, start, "right") - 1

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(flags, dtype=np.int64)])
        return run[stop] - run[start]

    has = lambda flag: (kind & flag) > 0
    letter = has(LETTER)
    sums = np.zeros((len(start), 7), dtype=np.int64)
    for i, flags in ((V, ~has(SPACE)), (L, letter), (W_, has(VOWEL)), (D, has(DIGIT)), (S, has(SEPARATOR))):
        sums[:, i] = total(flags)
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    word, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(start, word, "right") - 1
    inside = (line >= 0) & (word < stop[np.maximum(line, 0)])
    word, end, line = word[inside], end[inside], line[inside]
    if words not in _hashes:
        _hashes[words] = _Hashes(words)
    sums[:, N] = np.bincount(line, minlength=len(start))
    sums[:, C] = np.bincount(line[_hashes[words].common(_characters.lower[codes], word, end)], minlength=len(start))
    seen = np.flatnonzero(~has(SPACE))
    first = seen[np.searchsorted(seen, start)]  # the zeros at the end are visible
    item = (sums[:, V] > 0) & _list_items(codes, kind, np.minimum(first, len(codes) - 9))
    telling = np.flatnonzero(~has(CLOSER))
    at = np.searchsorted(telling, stop) - 1
    place = telling[np.maximum(at, 0)]
    told = (at >= 0) & (place >= start)
    return piece, sums, item, np.where(told, codes[place], 0)


def is_prose(sums: np.ndarray, item: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """Which whole lines read as natural prose: sentences with the common words of a known language, or with the
    shape of one that isn't known."""
    v, letters, vowels, _, separators, n, common = (sums[:, i] for i in range(7))
    usable = (n > 0) & (letters >= 0.68 * v) & (separators <= 0.15 * n) & ~(item & ~((n >= 12) & ended)) & ~((n < 6) & ~ended)
    short = (separators == 0) & (letters >= 0.75 * v) & ((common > 0) | (letters >= 4 * n))
    sound = vowels / np.maximum(1, letters)
    size = letters / np.maximum(1, n)
    shaped = (n >= 6) & ended & (separators == 0) & (0.32 <= sound) & (sound <= 0.58) & (3 <= size) & (size <= 10) & (letters >= 0.78 * v)
    return usable & np.where(n < 4, short, (common >= 0.16 * n) | shaped)


def _closed(sums: np.ndarray, item: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The TOTALS of whole lines, a row each; blank lines count nothing."""
    ended = np.isin(last, [ord(c) for c in _CLASSES[2][1]])
    out = np.c_[sums, np.ones(len(sums), dtype=np.int64), ended, item, np.where(is_prose(sums, item, ended), sums[:, V], 0)]
    return out * (sums[:, V] > 0)[:, None]


def _close(totals: list, line: tuple) -> list:
    """totals with a whole line added."""
    sums, item, last = line
    return [int(t + x) for t, x in zip(totals, _closed(np.array([sums]), np.array([bool(item)]), np.array([last]))[0], strict=True)]


def whole_totals(texts: list[str]) -> np.ndarray:
    """The TOTALS of whole documents, a row each."""
    out = np.zeros((len(texts), len(TOTALS)), dtype=np.int64)
    for at, block in _blocks([("", t, "") for t in texts]):
        piece, sums, item, last = _fragments(block)
        np.add.at(out, at + piece, _closed(sums, item, last))
    return out


def _blocks(pieces: list[tuple[str, str, str]]) -> Iterator[tuple[int, list[tuple[str, str, str]]]]:
    """pieces in runs of about BLOCK characters, each with the place of its first."""
    begin, size = 0, 0
    for i, p in enumerate(pieces):
        size += len(p[1])
        if size >= BLOCK or i + 1 == len(pieces):
            yield begin, pieces[begin : i + 1]
            begin, size = i + 1, 0


def chunk_states(pieces: list[tuple[str, str, str]]) -> list[tuple]:
    """(totals of complete lines, has a line break, head fragment, tail fragment) of each (before, chunk, after).

    before is the character ahead of the chunk ('' at the start of a document), after what follows it. Without a
    line break the whole chunk is the head and the tail is empty."""
    states = []
    for _, block in _blocks(pieces):
        piece, sums, item, last = _fragments(block)
        first = np.searchsorted(piece, np.arange(len(block)), "left")
        final = np.searchsorted(piece, np.arange(len(block)), "right") - 1
        between = np.ones(len(piece), dtype=bool)
        between[first] = between[final] = False
        totals = np.zeros((len(block), len(TOTALS)), dtype=np.int64)
        np.add.at(totals, piece[between], _closed(sums[between], item[between], last[between]))
        part = lambda i: (tuple(sums[i].tolist()), bool(item[i]), int(last[i]))  # noqa: B023, E731
        states += [(totals[i].tolist(), bool(f < z), part(f), part(z) if f < z else NOTHING) for i, (f, z) in enumerate(zip(first, final, strict=True))]
    return states


NOTHING = ((0,) * 7, False, 0)


def chunk_state(chunk: str, before: str, after: str) -> tuple:
    return chunk_states([(before, chunk, after)])[0]


def _join(a: tuple, b: tuple) -> tuple:
    """Two neighbouring fragments of one line as one; its first visible characters tell whether it is an item."""
    return (tuple(x + y for x, y in zip(a[0], b[0], strict=True)), a[1] if a[0][V] else b[1], b[2] or a[2])


def merge(a: tuple, b: tuple) -> tuple:
    """The state of two neighbouring parts of a document as that of one part; associative."""
    totals = [x + y for x, y in zip(a[0], b[0], strict=True)]
    if not a[1] and not b[1]:
        return (totals, False, _join(a[2], b[2]), NOTHING)
    if not a[1]:
        return (totals, True, _join(a[2], b[2]), b[3])
    if not b[1]:
        return (totals, True, a[2], _join(a[3], b[2]))
    return (_close(totals, _join(a[3], b[2])), True, a[2], b[3])


def finish(state: tuple) -> list:
    """The totals of a whole document."""
    totals = _close(list(state[0]), state[2])
    return _close(totals, state[3]) if state[1] else totals


_STATE = "totals array<long>, breaks boolean, sums array<long>, items array<boolean>, lasts array<int>"
_STATE_FIELDS = ["totals", "breaks", "sums", "items", "lasts"]


def _pack(state: tuple) -> tuple:
    totals, breaks, head, tail = state
    return (totals, breaks, [*head[0], *tail[0]], [head[1], tail[1]], [head[2], tail[2]])


def _unpack(row: tuple) -> tuple:
    totals, breaks, sums, items, lasts = row
    return ([int(x) for x in totals], bool(breaks), (tuple(sums[:7]), bool(items[0]), int(lasts[0])), (tuple(sums[7:]), bool(items[1]), int(lasts[1])))


def _count_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame(whole_totals(list(batch["text"])), columns=TOTALS)
        out.insert(0, "doc", batch["doc"].to_numpy())
        yield out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        states = [_pack(s) for s in chunk_states(list(zip(batch["before"], batch["chunk"], batch["after"], strict=True)))]
        yield pd.concat([batch[["doc", "row", "part"]].reset_index(drop=True), pd.DataFrame(states, columns=_STATE_FIELDS)], axis=1)


def _merge_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")
    states = [_unpack(r) for r in group[_STATE_FIELDS].itertuples(index=False, name=None)]
    total = states[0]
    for s in states[1:]:
        total = merge(total, s)
    out = pd.DataFrame([_pack(total)], columns=_STATE_FIELDS)
    for i, (name, value) in enumerate((("doc", group["doc"].iloc[0]), ("row", group["row"].iloc[0]), ("part", int(group["part"].iloc[0]) // FAN))):
        out.insert(i, name, [value])
    return out


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [finish(_unpack(r)) for r in batch[_STATE_FIELDS].itertuples(index=False, name=None)]
        out = pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(TOTALS)), columns=TOTALS)
        out.insert(0, "doc", batch["doc"].to_numpy())
        yield out


def document_totals(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, the TOTALS): a row for each row of documents whose text isn't null; doc is the key, which may repeat."""
    docs = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text is not null")
    doc_type = docs.schema["doc"].dataType.simpleString()
    final = f"doc {doc_type}, " + ", ".join(f"{t} long" for t in TOTALS)
    whole = docs.where(F.length("text") <= CHUNK).mapInPandas(_count_whole, final)
    # one pass cuts a text: the time is proportional to its length
    long = docs.where(F.length("text") > CHUNK).select("doc", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit("(?s).{1," + str(CHUNK) + "}"), F.lit(0)).alias("chunks"))
    beside = lambda i, of: F.coalesce(of(F.get("chunks", i)), F.lit(""))
    piece = lambda c, i: F.struct(i.alias("part"), c.alias("chunk"), beside(i - 1, lambda x: F.right(x, F.lit(1))).alias("before"), beside(i + 1, lambda x: F.left(x, F.lit(LOOK_AHEAD))).alias("after"))
    chunks = long.select("doc", "row", F.explode(F.transform("chunks", piece)).alias("c")).select("doc", "row", "c.*")
    schema = f"doc {doc_type}, row long, part int, {_STATE}"
    states = cut(chunks.repartition("row", "part").mapInPandas(_count, schema))
    most = (states.agg(F.max("part")).first()[0] or 0) + 1
    while most > 1:
        states = states.groupBy("row", F.floor(F.col("part") / FAN).alias("next")).applyInPandas(_merge_group, schema)
        most = -(-most // FAN)
    return whole.unionByName(states.mapInPandas(_finish, final))


def text_quality(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of documents: its measures and its kind, 'prose', 'not_prose' or 'empty'.

    Null texts have zero counts and null ratios, as blank ones, and are 'empty'. A text is 'prose' if at least half
    of its visible characters stand on lines that read as natural prose. Other columns of documents are ignored.
    Rows that repeat a key, or a whole row, give a row each.
    """
    rows = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    totals = document_totals(rows, "doc", "text")
    empty = rows.where("text is null").select("doc")
    both = totals.unionByName(empty, allowMissingColumns=True).na.fill(0, TOTALS)
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return both.select(
        F.col("doc").alias(key),
        F.col("visible").alias("n_visible"),
        F.col("words").alias("n_words"),
        F.col("lines").alias("n_lines"),
        share("letters", "words").alias("mean_word_length"),
        (1 - F.try_divide(F.col("letters") + F.col("digits"), F.col("visible"))).alias("symbol_ratio"),
        share("digits", "visible").alias("digit_ratio"),
        share("lines_ended", "lines").alias("punctuated_lines"),
        share("list_lines", "lines").alias("list_lines"),
        share("common", "words").alias("common_words"),
        share("prose", "visible").alias("prose_share"),
        F.when(F.col("visible") == 0, "empty").when(F.col("prose") * 2 >= F.col("visible"), "prose").otherwise("not_prose").alias("kind"),
    )
