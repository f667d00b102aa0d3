"""SimHash near-dedup, substring dedup and decontamination by brute force."""
import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from cohortia.llm import components as cc
from cohortia.llm import decontaminate as dc
from cohortia.llm import simhash as sh
from cohortia.llm import substring_dedup as sd


def plain_fingerprint(text):
    table = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    ws = (text or "").translate(table).encode().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[k:k + 3]) for k in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps):
    """Smallest id reachable over links of at most 3 bits."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def near_texts():
    random.seed(5)
    base = [[f"w{random.randint(0, 9999)}" for _ in range(300)] for _ in range(8)]
    texts = []
    for b in base:
        for k in range(12):
            copy = list(b)
            for _ in range(k):
                copy[random.randrange(300)] = f"x{random.randint(0, 99)}"
            texts.append(" ".join(copy))
    return [*texts, None, "", " \n", "One", "one", "Two Words", "É a B", "é a b", texts[0], texts[0].upper()]


def docs(spark, rows, extra="fp"):
    return spark.createDataFrame([(i, t, 9) for i, t in rows], f"doc_id bigint, text string, `{extra}` int")


def test_near_duplicates_match_brute_force(spark):
    texts = dict(enumerate(near_texts()))
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = classes(fps)
    assert len(set(want.values())) < len(want) - 20
    for limit in (256, 1):  # pairs of a posting, and links without pairs
        rows = sh.near_duplicates(docs(spark, texts.items()), pair_limit=limit).collect()
        assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == fps
        assert {r["doc_id"]: r["component_id"] for r in rows} == want
    kept = sh.keep_first(docs(spark, texts.items()))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_links_lose_nothing_at_the_bit_limit(spark):
    random.seed(11)
    values = set()
    for _ in range(40):
        x = random.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in random.sample(range(64), n)) for n in (1, 2, 3, 3, 3, 4, 5)}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    want = classes({v: v % (1 << 64) for v in signed})
    for limit in (256, 1):
        links = sh.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), limit)
        assert all((r["u"] ^ r["v"]).bit_count() <= 3 or ((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 3
                   for r in links.collect())
        roots = {r["node"]: r["root"] for r in cc.components(links).collect()}
        assert {v: roots.get(v, v) for v in signed} == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 500), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in cc.components(
        spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 300: 300, 301: 300}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words here now"), (None, "a b c d"), (None, "alone it is")]
    got = sh.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == 5
    kept = sorted(((r["doc_id"] or -1), r["text"]) for r in sh.keep_first(docs(spark, rows)).collect())
    assert kept == [(-1, "alone it is"), (1, "a b c d"), (1, "other words here now")]
    assert sh.near_duplicates(docs(spark, [])).count() == 0
    assert sh.keep_first(docs(spark, [])).count() == 0


def sentence(rng, n=8):
    return " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n)).capitalize() + "."


def plain_dedup(rows):
    """Quadratic version: all runs of every text in order of doc_id."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        spans = sd.sentences(t or "")
        norm = [" ".join((t or "")[a:b].lower().split()) for a, b in spans]
        n, gone, mine = len(spans), set(), []
        for f in range(n):
            for back in (False, True):
                order = range(f, -1, -1) if back else range(f, n)
                words, size = 0, 0
                for e in order:
                    words += len(norm[e].split())
                    size += 1
                    if size >= 2 and words >= sd.MIN_WORDS:
                        mine.append((min(f, e), max(f, e)))
                        break
        mine += [(k, k) for k, x in enumerate(norm) if len(x.split()) >= sd.LONG_WORDS]
        for a, b in sorted(set(mine)):
            key = tuple(norm[a:b + 1])
            if key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        kept = "".join(t[a:b] for k, (a, b) in enumerate(spans) if k not in gone) if t else t
        out[i] = kept.rstrip() if gone else t
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng) for _ in range(7))
    rows = {i: " ".join(sentence(rng) for _ in range(6)) for i in range(20)}
    for i in (3, 7, 8, 15):
        rows[i] = rows[i] + " " + passage + "\n" + sentence(rng)
    rows[16] = "lead words without end " + passage.upper() + " tail words"
    rows |= {17: rows[2], 18: None, 19: "", 20: "One. Two. Three.", 21: "One. Two. Three.",
             22: passage + "\n\n" + passage, 23: "no end " * 5000,
             24: "A b. " + "long " * 40 + "one. C d.", 25: "E f. " + "long " * 40 + "one. G h."}
    df = spark.createDataFrame([(i, t, 3, "c") for i, t in rows.items()],
                               "doc_id bigint, text string, n_removed int, run string")
    got = sd.dedup(df)
    assert got.columns == ["doc_id", "text", "run", "n_sentences", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_dedup(rows)
    held = [i for i, r in plain_dedup(rows).items() if passage[10:200].lower() in (r or "").lower()]
    assert held == [3]


def test_substring_dedup_repeated_rows_and_empty(spark):
    rng = random.Random(4)
    text, other = (" ".join(sentence(rng) for _ in range(5)) for _ in range(2))
    rows = [(1, text), (1, text), (1, other), (2, text), (None, other)]
    got = sorted(((r["doc_id"] or -1), r["text"]) for r in sd.dedup(docs(spark, rows)).collect())
    assert got == sorted([(1, text), (1, text), (1, ""), (2, ""), (-1, other)])
    assert sd.dedup(docs(spark, [])).count() == 0


ITEM = ("A train from Boston leaves at 9 km before noon and travels 120 km in 3 hours while the slow "
        "bus from Boston needs 7 hours for it.")


def swap(text, pairs):
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def test_contaminated_documents_are_caught(spark):
    filler = " ".join(f"f{k}" for k in range(40))
    other = "it was a plain evening with soft rain over all of the quiet hills and dark green woods nearby"
    rows = {
        1: filler + " " + ITEM + " " + filler, 2: ITEM.upper().lower(), 3: filler,
        4: swap(ITEM, [("Boston", "Denver"), ("120", "450"), ("9", "14"), ("7", "11"), ("3", "5")]),
        # one city became two different ones: not the same question
        5: " ".join(w + f" Town{k}" if w == "from" else w for k, w in enumerate(ITEM.replace("Boston", "").split())),
        6: None, 7: "", 8: filler + "\n" + ITEM.replace(" ", "\n ") + filler, 9: ITEM[:60], 10: other,
        11: filler + " " + other + " " + ITEM}
    df = spark.createDataFrame([(i, t, "z") for i, t in rows.items()], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(100, ITEM), (101, other), (102, None), (103, "too short"), (104, ""), (100, ITEM)],
                                  "item_id bigint, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()}
    assert {(1, 100), (2, 100), (4, 100), (8, 100), (10, 101), (11, 100), (11, 101)} <= hits
    assert not {d for d, _ in hits} & {3, 5, 6, 7, 9}
    left = dc.clean(df, bench)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == set(rows) - {d for d, _ in hits}
    assert dc.contaminated(df.limit(0), bench).count() == 0
    assert dc.clean(df, bench.limit(0)).count() == len(rows)


def test_planted_benchmark_passages(spark):
    d = "/root/testdata/sf0.001"
    docs_, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs_, items).collect()}
    want = set()
    texts = {r["doc_id"]: " ".join(r["text"].lower().split()) for r in docs_.collect()}
    for b in items.collect():
        key = " ".join(b["text"].lower().split())
        want |= {(i, b["item_id"]) for i, t in texts.items() if key in t}
    assert want and want == found


def test_copies_in_other_case_are_caught(spark):
    filler = " ".join(f"f{k}" for k in range(40))
    german = "wenn Anna über die große Straße nach Hause geht und dabei sieben Äpfel kauft, wie viele hat sie dann am Ende?"
    low = ITEM.lower()
    items = {100: ITEM, 101: german, 102: low.replace("train", "ship").replace("noon", "dusk")}
    rows = {k: filler + " " + change(t) + " " + filler for k, (t, change) in enumerate(
        (t, change) for t in items.values() for change in (str, str.upper, str.lower, str.title))}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()}
    assert {(k, 100 + k // 4) for k in rows} <= hits
    assert dc.clean(df, bench).count() == 0


def test_planted_benchmark_passages_of_the_larger_table(spark):
    d = "/root/testdata/sf0.1"
    docs_, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs_, items).collect()}
    keys = {b["item_id"]: " ".join(b["text"].lower().split()) for b in items.collect()}
    want = set()
    for r in docs_.collect():
        text = " ".join(r["text"].lower().split())
        want |= {(r["doc_id"], i) for i, key in keys.items() if key in text}
    assert {(1699, 130), (6420, 37), (8376, 101)} <= want
    assert want <= found
    # whatever else is found holds the item's template at one place
    texts = {r["doc_id"]: r["text"] for r in docs_.collect()}
    items_ = {b["item_id"]: b["text"] for b in items.collect()}
    wrong = {(d, i) for d, i in found - want if plain_share(texts[d], items_[i]) < dc.MIN_SHARE}
    assert not wrong


def plain_template(text, lower):
    """Template words ``(token, is literal, value)`` word by word, as the
    operator's docstring says."""
    out, before, opens, after_number = [], None, True, False
    for word in text.split():
        bare = word.strip(dc.PUNCTUATION)
        low = bare.lower()
        number = bare[:1].isdigit() or (bare[:1] in tuple("+-$€£") and bare[1:2].isdigit()) \
            or low in dc.NUMBER_WORDS
        unit = low in dc.UNITS and after_number
        name = bare[:1].isupper() and not opens and not number and not unit and not lower
        token = "<unit>" if unit else "<num>" if number else "<name>" if name else bare.casefold()
        literal = not (number or unit or name)
        if literal or token != before:
            out.append((token, literal, bare.casefold()))
        before = None if literal else token
        opens, after_number = word[-1] in ".!?:" or not bare, number
    return out


def plain_share(doc, item):
    """Best share of the item's windows at one shift with consistent slots."""
    best = 0.0
    for lower in (False, True):
        d, i = plain_template(doc, lower), plain_template(item, lower)
        width = min(5, len(i))
        usable = [p for p in range(len(i) - width + 1) if sum(x[1] for x in i[p:p + width]) >= 3]
        for shift in range(-len(i), len(d)) if usable else ():
            covered = [p for p in usable if p + shift >= 0 and [x[0] for x in i[p:p + width]]
                       == [x[0] for x in d[p + shift:p + shift + width]]]
            values = {}
            for x in {x for p in covered for x in range(p, p + width) if not i[x][1]}:
                values.setdefault(i[x][2], []).append(d[x + shift][2])
            if all(max(v.count(w) for w in v) >= 0.8 * len(v) for v in values.values()):
                best = max(best, len(covered) / len(usable))
    return best


def test_contamination_equals_plain_version(spark):
    random.seed(9)
    word = lambda: random.choice("river stone walks carries under quiet lamp green count many left".split())
    name = lambda: random.choice(["Anna", "Boris", "Clara", "Denver", "Esben"])
    number = lambda: str(random.randint(2, 99))
    frame = [word() for _ in range(9)]  # opens several items: their windows are not rare

    def question(k):
        body = (frame if k % 2 else []) + [random.choice((word, word, word, word, name, number))()
                                           for _ in range(14 + k % 9)]
        return " ".join(body).capitalize() + "?"
    items = {k: question(k) for k in range(14)}
    docs_, filler = {}, lambda n: " ".join(word() for _ in range(n))
    for k, text in items.items():
        values = sorted({w for _, literal, w in plain_template(text, False) if not literal})
        other = {v: (number() if v.isdigit() else name()) for v in values}
        put = [other.get(w.strip("?").casefold(), w) for w in text.split()]
        mixed = [(number() if w.isdigit() else name()) if w.strip("?").casefold() in other else w
                 for w in text.split()]
        cut = text.split()[:int(len(text.split()) * random.choice((0.6, 0.8, 0.9, 0.95)))]
        for j, t in enumerate((text, text.upper(), " ".join(put), " ".join(mixed), " ".join(cut))):
            docs_[10 * k + j] = filler(5) + ". " + t + " " + filler(6)
    docs_ |= {1000 + k: " ".join(frame) + " " + filler(30) for k in range(10)}
    df = spark.createDataFrame(list(docs_.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in dc.contaminated(df, bench).collect()}
    want = {(d, i) for d, t in docs_.items() for i, u in items.items() if plain_share(t, u) >= dc.MIN_SHARE}
    assert 20 < len(want) < len(docs_) and set(got) == want


def test_clean_rows_that_share_an_id_stay(spark):
    rows = [(1, ITEM), (1, "a clean row"), (None, ITEM), (None, "another clean row"), (2, ITEM), (2, ITEM),
            (3, "twice"), (3, "twice"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
    bench = spark.createDataFrame([(None, ITEM), (7, ITEM)], "item_id bigint, text string")
    left = [(r["doc_id"], r["text"]) for r in dc.clean(df, bench).collect()]
    assert sorted(left, key=str) == sorted((r for r in rows if r[1] != ITEM), key=str)
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()} == {
        (d, i) for d in (1, 2, None) for i in (7, None)}


def share(doc, item):
    (d,), (i,) = (dc._texts(dc.Encoded([t]), False) for t in (doc, item))
    return dc._matches(d, i, dc.MIN_SHARE)


def test_items_that_repeat_a_frame(spark):
    filler = " ".join(f"f{k}" for k in range(40))
    counts = [12, 15, 18, 12, 40, 7, 15, 33]
    item = "On monday the shop " + ", ".join(f"sold {n} red apples" for n in counts) + " and then it closed."
    shifted = filler + " " + ", ".join(f"sold {n} red apples" for n in range(50, 90))
    rows = {
        1: item, 2: filler + " " + item + " " + filler, 3: shifted + ". " + item + " " + shifted,
        4: swap(item, [(f"{n} ", f"{n + 100} ") for n in set(counts)]),
        5: swap(item, [("18 red apples", "18 small red apples")]),
        6: swap(item, [("40 red", "40")]),
        # one number stands for many: not the same question
        7: "On monday the shop " + ", ".join(f"sold {k} red apples" for k in (1, 2, 3, 4, 5, 6, 7, 8))
           + " and then it closed.",
        8: "On monday the shop " + ", ".join(
            f"sold {k} red apples" + " now" * (k == 3) for k in (1, 2, 3, 4, 5, 6, 7, 8)) + " and then it closed.",
        9: filler}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame([(100, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r["containment"] for r in dc.contaminated(df, bench).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1] == got[2] == got[3] == got[4] == 1
    assert share(item, item) == 1
    assert share(item.replace("sold 15", "bought 15", 1), item) >= dc.MIN_SHARE
    many = filler + (", ".join(f"sold {n} red apples" for n in range(3000)) + ". ") + item
    assert share(many, item) == 1


def test_one_inserted_word_does_not_hide_other_slots():
    item = ("a clerk from Boston counts 120 old coins while a tired guard from Boston watches the long "
            "grey corridor and a small dog from Boston sleeps under the heavy oak table near the door")
    assert share(item.replace("grey", "very grey"), item) >= dc.MIN_SHARE
    other = item.replace("Boston", "Denver", 1).replace("dog from Boston", "dog from Austin")
    assert share(other, item) == 0
    assert share(other.replace("grey", "very grey"), item) < dc.MIN_SHARE


def test_items_without_a_template_window_are_compared_literally(spark):
    filler = " ".join(f"f{k}" for k in range(40))
    items = {100: "Compute 12 / 7", 101: "2 + 2 = 4", 102: "Solve!", 103: "12 13 14 15 16 17 18",
             104: "too short", 105: "3 4 x 5 6 y 7 8"}
    rows = {k: filler + " " + t + ". " + filler for k, t in items.items()}
    near = {1: "compute 12 - 7", 2: "2 + 2 = 5", 3: "solved", 4: "12 13 14 15 16 17 19", 5: "too very short",
            6: "3 4 x 5 6 y 7 9", 7: filler, 8: "", 9: None, 10: "12 13 14 15 16"}
    upper = {k + 100: t.upper() for k, t in items.items()}
    df = spark.createDataFrame([*rows.items(), *near.items(), *upper.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([*items.items(), (106, ""), (107, None), (108, ITEM)],
                                  "item_id bigint, text string")
    hits = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()}
    assert hits == {(k, k) for k in items} | {(k + 100, k) for k in items}
    assert {r["doc_id"] for r in dc.clean(df, bench).collect()} == set(near)


def test_passages_inside_sentences_can_escape():
    """The limit that the README names: no run of two glued copies is the same."""
    def words(n, mark):
        return " ".join(f"{mark}{k}" for k in range(n))

    def shared(passage):
        one, two = ({h for h, _, _ in sd.runs(f"{words(9, a)} {passage} {words(9, b)}.")} for a, b in ("ab", "cd"))
        return len(one & two)
    inner = [f"{words(13, 'p')}. {words(n, 'q')}. {words(13, 'r')}" for n in (29, 30)]
    assert [shared(x) for x in inner] == [0, 1]
    assert shared(words(60, "p")) == 0
    assert shared(f"{words(13, 'p')}. {words(10, 'q')}. {words(10, 's')}. {words(13, 'r')}") > 0
