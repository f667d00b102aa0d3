"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, units after a number and names (capitalised
words that do not open a sentence) become typed placeholders, neighbouring
equal placeholders one; other words are lower-cased and lose outer
punctuation. Windows of five template words are hashed and the windows of all
documents hash-joined with those of the benchmark items, both as they are and
in lower case (without names), since a copy in lower or upper case has no names
or nothing else. An item whose windows occur in a document of the same form
(0.8 of them at least) is then checked for slot
consistency: reading item and document side by side (each window of the item
at one place of the document, whichever shift it is tried at), each number, name
or unit of the item must stand for one and the same value of the document. So a
question with other numbers or names is caught, a text that merely shares the
frame is not.

Windows need three literal words at least; items of three or four template
words are taken as one window. An item without such a window (shorter, or dense
in numbers) is compared literally: its whole sequence of words, numbers included,
must occur in the document. Its first words, five at most, are its window in the
join, so a document has at most ten kinds of windows however many lengths the
items have.

Edge cases: null and empty texts match nothing; a null doc_id or item_id is an
id like any other; rows that share a doc_id, or have none, are judged by their
own texts (``contaminated`` names the id, ``clean`` drops the row); repeated rows of a document are verified row by row, an
item that occurs twice in the benchmark gives two hits of the same item_id
once; empty tables give an empty result; other columns are ignored. Window
hashes travel as arrays and are exploded beside the join, so the documents are
not shuffled while the benchmark's windows fit the broadcast threshold, and
are joined by a skew-split shuffle beyond it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

WINDOW = 5
MIN_LITERALS = 3
MIN_SHARE = 0.8
# words that are units when they follow a number (fixed list)
UNITS = frozenset("""% $ € £ c cm m mm km in ft yd mi inch inches foot feet yard yards mile miles
g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons
l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years dollar dollars cent cents euro euros mph kmh
°c °f degree degrees percent kb mb gb tb hz khz mhz ghz w kw v a""".split())
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve
twenty thirty forty fifty hundred thousand million billion dozen""".split())
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*_`|/\\"
KEPT_WORDS = 400_000
NUM, UNIT, NAME = (xxhash.xxh64_intdigest(x) for x in (b"<num>", b"<unit>", b"<name>"))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


class Words:
    """Codes of words; the properties of each code are kept as arrays."""

    def __init__(self):
        self.code: dict[str, int] = {}
        self.new: list[tuple[int, int, bool, bool, bool, bool]] = []
        self.columns = [np.empty(0, t) for t in (np.uint64, np.uint64, bool, bool, bool, bool)]

    def add(self, word: str) -> int:
        bare = word.strip(PUNCTUATION)
        low = bare.lower()
        folded = bare.casefold()
        number = bool(bare) and (bare[0].isdigit() or (bare[0] in "+-$€£" and bare[1:2].isdigit())
                                 or low in NUMBER_WORDS)
        self.new.append((xxhash.xxh64_intdigest(folded.encode()),
                         xxhash.xxh64_intdigest((folded or word).encode()), number, low in UNITS,
                         bare[:1].isupper(), word[-1] in ".!?:" or not bare))
        self.code[word] = len(self.code)
        return self.code[word]

    def encode(self, words: list[str]) -> np.ndarray:
        get, add = self.code.get, self.add
        return np.array([c if (c := get(w)) is not None else add(w) for w in words], np.int64)

    def properties(self, codes: np.ndarray) -> list[np.ndarray]:
        """Hash, hash that tells signs apart, number, unit, upper case, ends a
        sentence: one array each."""
        if self.new:
            self.columns = [np.concatenate([old, np.array(add, old.dtype)]) for old, add in zip(
                self.columns, zip(*self.new, strict=True), strict=True)]
            self.new = []
        return [c[codes] for c in self.columns]


_WORDS = Words()


class Encoded:
    """Words of several texts, one text after the other, and their properties."""

    def __init__(self, texts: list[str]):
        global _WORDS
        if len(_WORDS.code) > KEPT_WORDS:
            _WORDS = Words()
        self.texts = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        codes = np.concatenate([np.empty(0, np.int64), *(_WORDS.encode(w) for w in self.texts)])
        self.hashes, self.exact, number, unit, upper, ends = _WORDS.properties(codes)
        first = np.zeros(len(codes), bool)
        first[self.starts[:-1][self.sizes > 0]] = True
        self.first, self.number = first, number
        self.unit = unit & np.concatenate([[False], number])[:len(codes)] & ~first
        opens = np.concatenate([[True], ends])[:len(codes)] | first
        self.name = upper & ~opens & ~number & ~self.unit

    def literally(self, text: int) -> np.ndarray:
        return self.exact[self.starts[text]:self.starts[text + 1]]

    def windows(self, width: int, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Literal windows of ``width`` words, and the bounds of each text's;
        only the first of each text if ``first``."""
        counts = np.maximum(self.sizes - width + 1, 0)
        if first:
            counts = np.minimum(counts, 1)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(bounds[-1]) + np.repeat(self.starts[:-1] - bounds[:-1], counts)
        out = np.full(len(at), width, np.uint64)
        for k in range(width):
            out += self.exact[at + k] * _FACTORS[k]
        out ^= out >> np.uint64(29)
        return out.view(np.int64), bounds


class Templates:
    """Template words of several texts, one after the other: ``hashes``,
    ``literal``, ``named`` (a name, if only in the text as it is), ``word``
    (index of the word in its text), ``bounds`` (text t has the template words
    bounds[t] to bounds[t + 1]) and ``texts`` (words). In the lower-case form
    names are literal words."""

    def __init__(self, words: Encoded, lower: bool):
        self.texts, self.lower = words.texts, lower
        hashes, first = words.hashes.copy(), words.first
        hashes[words.number], hashes[words.unit] = NUM, UNIT
        slot = words.number | words.unit
        if not lower:
            hashes[words.name] = NAME
            slot |= words.name
        keep = np.ones(len(hashes), bool)
        keep[1:] = ~(slot[1:] & slot[:-1] & (hashes[1:] == hashes[:-1])) | first[1:]
        self.hashes, self.literal, self.named = hashes[keep], ~slot[keep], words.name[keep]
        self.word = (np.arange(len(hashes)) - np.repeat(words.starts[:-1], words.sizes))[keep]
        self.bounds = np.concatenate([[0], np.cumsum(keep)])[words.starts]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window that lies in one text (0: too few literal
        words), and the bounds of each text's windows."""
        sizes = np.diff(self.bounds)
        counts = np.maximum(sizes - width + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        n = len(self.hashes) - width + 1
        if n < 1 or not bounds[-1]:
            return np.empty(0, np.int64), bounds
        out = np.full(n, width, np.uint64)
        literals = np.zeros(n, np.int64)
        for k in range(width):
            out += self.hashes[k:k + n] * _FACTORS[k]
            literals += self.literal[k:k + n]
        out ^= out >> np.uint64(29)
        out[literals < min(MIN_LITERALS, width)] = 0
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], counts)
        return out[at].view(np.int64), bounds

    def with_names(self, width: int) -> np.ndarray:
        """Whether each window of ``windows`` holds a name."""
        counts = np.maximum(np.diff(self.bounds) - width + 1, 0)
        starts = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(starts[-1]) + np.repeat(self.bounds[:-1] - starts[:-1], counts)
        names = np.concatenate([[0], np.cumsum(self.named)])
        return names[at + width] > names[at]


def _parts(texts: list[str], limit: int = 1 << 21) -> Iterator[list[int]]:
    """Rows of a batch in parts of about ``limit`` characters."""
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def windows(table: DataFrame, id_col: str, text_col: str, item: bool,
            widths: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """``id, form, width, hashes`` (usable windows) per text, form (0: as it is,
    1: lower case, 2: literal, widths below 0) and width; of an item only the
    form's own width, the full one or its length. What the forms share is given
    once: form 0 of an item without names is left out, form 1 of a document has
    only the windows with a name (the others are among those of form 0). An item
    has form 2, and of it the first window, if it has no window of form 1."""
    slim = table.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for rows in _parts(texts):
                words = Encoded([texts[i] for i in rows])
                ids = b.column("id").take(pa.array(rows, pa.int64()))
                named = np.diff(np.concatenate([[0], np.cumsum(words.name)])[words.starts]) > 0
                searched = np.zeros(len(rows), bool)

                def batch(form, width, hashes, bounds, wanted, ids=ids, rows=rows):
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                                     pa.array(hashes, pa.int64()))
                    return pa.RecordBatch.from_arrays(
                        [ids, pa.array([form] * len(rows), pa.int32()),
                         pa.array([width] * len(rows), pa.int32()), lists],
                        names=["id", "form", "width", "hashes"]).filter(pa.array(wanted))

                for form in (0, 1):
                    found = Templates(words, lower=form == 1)
                    own = np.minimum(np.diff(found.bounds), WINDOW)
                    for w in sorted({int(x) for x in own if x >= MIN_LITERALS}) if item else [
                            x for x in widths if x > 0]:
                        hashes, bounds = found.windows(w)
                        keep = hashes != 0
                        if form == 1 and not item and len(keep):
                            keep &= found.with_names(w)
                        bounds = np.concatenate([[0], np.cumsum(keep)])[
                            np.minimum(bounds, len(keep))]
                        wanted = np.diff(bounds) > 0
                        if item:
                            wanted &= (own == w) & (named | (form == 1))
                            if form == 1:
                                searched |= wanted
                        yield batch(form, w, hashes[keep], bounds, wanted)
                own = np.minimum(words.sizes, WINDOW)
                for w in sorted({int(x) for x in own[~searched] if x}) if item else [
                        -x for x in widths if x < 0]:
                    hashes, bounds = words.windows(w, first=item)
                    yield batch(2, -w, hashes, bounds, (own == w) & ~searched if item
                                else np.diff(bounds) > 0)

    return slim.mapInArrow(run, f"id {kind}, form int, width int, hashes array<bigint>")


class Text:
    """Template words, windows and words of one text."""

    def __init__(self, all_texts: Templates, number: int, windows: dict[int, tuple]):
        a, b = all_texts.bounds[number], all_texts.bounds[number + 1]
        self.literal, self.word = all_texts.literal[a:b], all_texts.word[a:b]
        self.words = all_texts.texts[number]
        self.size = int(b - a)
        self._windows, self._all, self._number = windows, all_texts, number

    def windows(self, width: int) -> np.ndarray:
        if width not in self._windows:
            self._windows[width] = self._all.windows(width)
        hashes, bounds = self._windows[width]
        return hashes[bounds[self._number]:bounds[self._number + 1]]

    def value(self, place: int) -> str:
        return self.words[self.word[place]].strip(PUNCTUATION).casefold()


def _texts(words: Encoded, lower: bool) -> list[Text]:
    """The texts of one part; their windows are hashed together."""
    found, shared = Templates(words, lower), {}
    return [Text(found, i, shared) for i in range(len(words.texts))]


def _holds(document: np.ndarray, item: np.ndarray) -> float:
    """1 if the words of the item occur one after the other, else 0."""
    at = np.arange(max(len(document) - len(item) + 1, 0))
    for k, h in enumerate(item):
        at = at[document[at + k] == h]
        if not len(at):
            return 0.0
    return float(len(item) > 0)


def _matches(d: Text, i: Text, least: float) -> float:
    """Share of the item's windows that the document holds in one place with
    consistent slots."""
    width = min(WINDOW, i.size)
    d_win, i_win = d.windows(width), i.windows(width)
    usable = int((i_win != 0).sum())
    places: dict[int, list[int]] = {}
    for p, h in enumerate(i_win.tolist()):
        if h:
            places.setdefault(h, []).append(p)
    hit = np.flatnonzero(np.isin(d_win, list(places))) if places else []
    by_shift: dict[int, set[int]] = {}
    for q in hit:
        for p in places[int(d_win[q])]:
            by_shift.setdefault(int(q) - p, set()).add(p)
    # an occurrence: neighbouring shifts (an inserted or lost word moves it)
    best = 0.0
    for group in _near(sorted(by_shift), i.size):
        if len(set().union(*(by_shift[s] for s in group))) < least * usable:
            continue
        # the item at one place; about this place with words lost or put in; anywhere
        for s in sorted(group, key=lambda x: (-len(by_shift[x]), x)):
            alone = {p: s for p in by_shift[s]}
            known = _slots(d, i, width, alone)
            about = [x for x in group if abs(x - s) <= i.size]
            for at in (alone, None):
                if best < 1 and (at or len(set().union(*(by_shift[x] for x in about))) > best * usable):
                    at = at or _aligned(d, i, width, about, by_shift, known)
                    if _consistent(_slots(d, i, width, at), least):
                        best = max(best, len(at) / usable)
        if best < 1:
            at = _aligned(d, i, width, group, by_shift, {})
            if _consistent(_slots(d, i, width, at), least):
                best = max(best, len(at) / usable)
    return best


def _slots(d: Text, i: Text, width: int, at: dict[int, int]) -> dict[str, Counter]:
    """Document values of each slot value of the item, for windows ``at`` their
    shifts; a slot of the item is read once."""
    place = {}
    for p in sorted(at):
        for x in range(p, p + width):
            if not i.literal[x]:
                place.setdefault(x, x + at[p])
    values: dict[str, Counter] = {}
    for x, q in place.items():
        values.setdefault(i.value(x), Counter())[d.value(q)] += 1
    return values


def _consistent(values: dict[str, Counter], least: float) -> bool:
    return all(max(c.values()) >= least * sum(c.values()) for c in values.values())


def _aligned(d: Text, i: Text, width: int, shifts: list[int], by_shift: dict[int, set[int]],
             known: dict[str, Counter]) -> dict[int, int]:
    """Shift of each item window in the alignment, in the order of the document,
    that covers most windows; of those about equal the one that contradicts the
    ``known`` slots least. Windows that have a place out of order only are added
    where they contradict no slot."""
    value = {v: c.most_common(1)[0][0] for v, c in known.items()}
    reach = max(2, i.size // 4)
    open_at: dict[int, list[int]] = {}
    for s in shifts:
        for p in by_shift[s]:
            open_at.setdefault(p, []).append(s)

    def against(p: int, s: int) -> int:
        return sum(value.get(i.value(x), w := d.value(x + s)) != w
                   for x in range(p, p + width) if not i.literal[x])

    nodes: list[tuple[float, int, int, int]] = []
    ends: dict[int, tuple[list[int], list[int]]] = {s: ([], []) for s in shifts}
    for p in sorted(open_at):
        new = []
        for s in open_at[p]:
            score, back = 0.0, -1
            for t in shifts[bisect_left(shifts, s - reach):bisect_right(shifts, s + reach)]:
                places, best = ends[t]
                k = bisect_left(places, p + min(0, s - t)) - 1
                if k >= 0 and (x := nodes[best[k]][0] - (0.05 if t != s else 0)) > score:
                    score, back = x, best[k]
            # at most two slots a window: covering it always counts
            new.append((score + 1 - 0.4 * against(p, s), p, s, back))
        for node in new:
            places, best = ends[node[2]]
            places.append(node[1])
            best.append(best[-1] if best and nodes[best[-1]][0] > node[0] else len(nodes))
            nodes.append(node)
    at: dict[int, int] = {}
    k = max(range(len(nodes)), key=lambda x: nodes[x][0])
    while k >= 0:
        _, p, s, k = nodes[k]
        at[p] = s
    value = {v: c.most_common(1)[0][0] for v, c in _slots(d, i, width, at).items()}
    now = at[min(at)]
    for p in sorted(open_at):
        if p not in at:
            loose = [s for s in open_at[p] if abs(s - now) <= reach and not against(p, s)]
            if loose:
                at[p] = min(loose, key=lambda s: (abs(s - now), s))
                for v, c in _slots(d, i, width, {p: at[p]}).items():
                    value.setdefault(v, next(iter(c)))
        now = at.get(p, now)
    return at


def _near(shifts: list[int], reach: int) -> list[list[int]]:
    groups: list[list[int]] = []
    for s in shifts:
        if groups and s - groups[-1][-1] <= max(2, reach // 4):
            groups[-1].append(s)
        else:
            groups.append([s])
    return groups


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document and item: ``doc_id, item_id,
    n_windows`` (usable ones of the item), ``containment``."""
    found = hits(docs, benchmark, min_share, id_col, text_col, item_col, item_text_col)
    return found.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("containment").alias("containment"))


def probes(items: DataFrame, min_share: float) -> DataFrame:
    """``item_id, width, hashes`` and ``probes``: the windows of an item that
    fewest items share, one more than it may lack. A document that holds enough
    of the item holds one of them."""
    owners = items.groupBy("width", "hash").agg(F.countDistinct("item_id").alias("owners"))
    ranked = items.distinct().join(owners, ["width", "hash"]).groupBy("item_id", "width").agg(
        F.array_sort(F.collect_list(F.struct("owners", "hash"))).alias("ranked"))
    n = F.size("ranked")
    may_lack = n - F.ceil(n * F.lit(min_share) - 1e-9)
    return ranked.select("item_id", "width", F.col("ranked.hash").alias("hashes"),
                         F.slice(F.col("ranked.hash"), F.lit(1), may_lack.cast("int") + 1).alias("probes"))


def candidates(docs: DataFrame, items: DataFrame, min_share: float) -> DataFrame:
    """``c_key, c_item, n_windows``: texts (``key``) and items of which they
    hold enough windows, in any order and place.

    The occurrences of a window in the corpus are joined once, however many
    items share it; a text meets an item only over one of the item's probes."""
    # at most WINDOW different widths, and as many of literal windows
    widths = tuple(sorted(r[0] for r in items.select("width").distinct().collect()))
    known = written(items.select(F.col("width").alias("k_width"),
                                 F.col("hash").alias("k_hash")).distinct(), "known-windows")
    every = written(probes(items, min_share), "probes")
    found = windows(docs, "key", "text", item=False, widths=widths).select(
        F.col("id").alias("c_key"), "width", F.explode("hashes").alias("hash"))
    # a set per text: its windows that any item has
    held = written(found.join(known, (F.col("hash") == F.col("k_hash"))
                              & (F.col("width") == F.col("k_width")))
                   .groupBy("c_key", "width").agg(F.collect_set("hash").alias("held")), "held-windows")
    met = held.select("c_key", "width", F.explode("held").alias("hash")).join(
        every.select("width", F.col("item_id").alias("c_item"), F.explode("probes").alias("hash")),
        ["width", "hash"]).select("c_key", "width", "c_item").distinct()
    both = met.join(held, ["c_key", "width"]).join(
        every.select(F.col("item_id").alias("c_item"), "width", "hashes"), ["c_item", "width"])
    n = F.size("hashes")
    return both.filter(F.size(F.array_intersect("held", "hashes")) >= min_share * n).select(
        "c_key", "c_item", n.cast("long").alias("n_windows"))


def hits(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, item_id, n_windows, containment``; the text hash
    tells rows of one doc_id with different texts apart."""
    items = written(windows(benchmark, item_col, item_text_col, item=True)
                    .select(F.struct(F.col("id").alias("item"), "form").alias("item_id"), "width",
                            F.explode("hashes").alias("hash")), "items")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.struct(F.col(id_col).alias("doc_id"),
                                 F.xxhash64(text).alias("text_hash")).alias("key"), text.alias("text"))
    near = written(candidates(texts, items, min_share), "candidates")
    of_items = benchmark.select(F.col(item_col).alias("b_item"),
                                F.col(item_text_col).cast("string").alias("item_text"))
    rows = (texts.join(near, F.col("key").eqNullSafe(F.col("c_key")))
            .join(of_items, F.col("c_item.item").eqNullSafe(F.col("b_item")))
            .select("key", F.col("c_item").alias("item_id"), "n_windows", "text", "item_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            of_items = [t or "" for t in b.column("item_text").to_pylist()]
            forms = b.column("item_id").field("form").to_pylist()
            shares_of = []
            for part in _parts(texts):
                d_words = Encoded([texts[k] for k in part])
                i_words = Encoded([of_items[k] for k in part])
                pairs = {form: list(zip(_texts(d_words, form == 1), _texts(i_words, form == 1),
                                        strict=True)) for form in {forms[k] for k in part} - {2}}
                shares_of += [
                    _holds(d_words.literally(n), i_words.literally(n)) if forms[k] == 2
                    else _matches(*pairs[forms[k]][n], min_share) for n, k in enumerate(part)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("item_id"), b.column("n_windows"),
                 pa.array(shares_of, pa.float64())],
                names=["key", "item_id", "n_windows", "containment"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    checked = rows.mapInArrow(verify, f"key {kinds['key']}, item_id {kinds['item_id']}, "
                                      "n_windows bigint, containment double")
    return checked.filter(F.col("containment") >= min_share).select(
        "key.doc_id", "key.text_hash", "item_id.item", "n_windows", "containment").groupBy(
        "doc_id", "text_hash", F.col("item").alias("item_id")).agg(
        F.max("n_windows").alias("n_windows"), F.max("containment").alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark item, all columns unchanged. A row goes
    for its own text: others of the same doc_id, or without one, stay."""
    bad = written(hits(docs, benchmark).select(
        F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct(),
        "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (
        F.xxhash64(F.col("text").cast("string")) == F.col("__bad_hash")), "left_anti")
