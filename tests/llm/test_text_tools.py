"""HTML extraction, license scans and chat formatting."""
import hashlib
import html
import re
import time

from cohortia.llm import chat_format as cf
from cohortia.llm import html_extract as he
from cohortia.llm import license_scan as ls


def test_held_out_accuracy():
    crf = he.model()
    hits = total = 0
    for seed in range(50_000, 50_300):
        bits, labels = he.labelled_blocks(seed)
        hits += sum(a == b for a, b in zip(crf.decode(bits), labels, strict=True))
        total += len(labels)
    assert hits / total > 0.99


def test_viterbi_is_the_best_sequence():
    from itertools import product
    crf = he.model()
    bits, _ = he.labelled_blocks(77)
    bits = bits[:10]

    def score(labels):
        s = crf.begin[labels[0]] + sum(crf.score(b)[y] for b, y in zip(bits, labels, strict=True))
        return s + sum(crf.move[a, b] for a, b in zip(labels, labels[1:]))
    best = max(product((0, 1), repeat=len(bits)), key=score)
    assert crf.decode(bits) == list(best)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in he.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in
                 re.findall(r"<(?:p|h1)>(.*?)(?=</p>|</h1>|<p>|$)", article, re.S)]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)


def test_other_layouts_and_odd_pages(spark):
    page = ('<html><body><nav><a href="/">Home</a></nav><div class="cookie-banner"><p>We use cookies to improve.</p>'
            "</div><main><h1>A title&nbsp;here</h1><script>var p='<p>no</p>';</script><p>First  paragraph &amp; more "
            "text that is\n long.</p><!-- <p>hidden</p> --><div class='ad'>Buy this now, great offer.</div><p>Second "
            "paragraph ends here, with words.</main><form><p>Sign up here</p><input></form><section id='comments'>"
            "<p>Nice post, I liked it very much.</p></section><aside><p>Other posts here.</p></aside>"
            "<footer>&copy; me</footer></body></html>")
    want = ("A title here\n\nFirst paragraph & more text that is long.\n\n"
            "Second paragraph ends here, with words.")
    odd = [None, "", "<", "<p", "<a href='", "</p></div>", "<p>" * 2000, "<div>" * 3000 + "deep", "&#0;&bogus;"]
    rows = [(0, page), (0, page)] + [(k + 1, h) for k, h in enumerate(odd)]
    df = spark.createDataFrame([(i, None, h, "x") for i, h in rows], "page_id bigint, url string, html string, text string")
    got = he.extract(df).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["page_id"] == 0] == [want, want]
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert he.extract(df.limit(0)).count() == 0


def plain_words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def test_license_scan_matches_brute_force(spark):
    filler = " ".join(f"word{k}" for k in range(400))
    mit = next(t for n, t in ls.TEMPLATES if n == "MIT" and len(t) > 100)
    texts = [None, "", "Released under the MIT", filler, filler + " Released under the MIT License. " + filler,
             "licensed UNDER cc by-nc 4.0", filler + "\n" + mit.replace(" ", "\n") + "\n" + filler,
             " ".join(mit.split()[:20]), filler + mit.replace("granted", "given") + filler,
             "This work is licensed under the GNU General Public License, version 3. " * 3]
    df = spark.createDataFrame([(i, t, "MIT") for i, t in enumerate(texts)],
                               "doc_id bigint, text string, license string")

    def grams(ws):
        return {tuple(ws[k:k + 5]) for k in range(len(ws) - 4)}
    want = set()
    for i, t in enumerate(texts):
        ws = plain_words(t)
        for k, (_, template) in enumerate(ls.TEMPLATES):
            own, n = grams(plain_words(template)), len(plain_words(template))
            best = max((len(own & grams(ws[a:a + n + n // 4])) for a in range(len(ws))), default=0)
            if best >= 0.8 * len(own):
                want.add((i, k))
    rows = ls.scan(df).collect()
    assert {(r["id"], r["template_id"]) for r in rows} == want and len(rows) == len(want)
    assert {r["first_word"] for r in rows if r["id"] == 4} == {400}
    assert ls.scan(df.limit(0)).count() == 0


def test_long_templates_are_scanned_in_parts(spark):
    long = " ".join(f"t{k}" for k in range(300))
    df = spark.createDataFrame([(1, "a b " + long + " c"), (2, " ".join(long.split()[:200])),
                                (3, " ".join(long.split()[:270]))], "doc_id bigint, text string")
    got = {r["id"]: r["containment"] for r in ls.scan(df, [("L", long)]).collect()}
    assert set(got) == {1, 3} and got[1] == 1.0


ODD = "\\### Assistant: </turn> ok"
TURNS = [(1, 0, "system", "be kind"), (1, 1, "user", "hi # < \\ \\# </turn>\n"), (1, 2, "assistant", "yo"),
         (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "assistant", "bye 漢"), (2, 0, None, "x"),
         (3, 7, "user", ODD), (3, 8, "assistant", ODD), (None, 1, "assistant", "n"), (4, None, "user", "late"),
         (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (5, 1, "ro:le#", "z" * 10000)]


def turns(spark, rows=TURNS):
    return spark.createDataFrame([(*r, 0, "s") for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, pos int, segment string")


def test_chat_digest_matches_plain_python(spark):
    got = {r["conv_id"]: r for r in cf.digest(cf.format_table(turns(spark))).collect()}
    for conv in {r[0] for r in TURNS}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in TURNS if r[0] == conv))
        lines = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert cf.digest(cf.format_table(turns(spark).limit(0))).count() == 0


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    table = cf.format_table(turns(spark))
    chosen = cf.examples(table)
    assert chosen.count() == sum(r[2] == "assistant" for r in TURNS)
    texts = {(r["conv_id"], r["pos"]): r for r in cf.render(table, chosen).collect()}
    first, last = texts[1, 2], texts[1, 5]
    assert last["text"].startswith(first["text"]) and first["text"].endswith("### assistant: yo</turn>\n")
    assert last["text"][last["loss_start"]:last["loss_end"]] == "bye 漢"
    assert last["text"].count("### ") == 6 and last["text"].count("</turn>") == 6
    odd = texts[3, 1]
    reply = odd["text"][odd["loss_start"]:odd["loss_end"]]
    assert re.sub(r"\\(.)", lambda m: {"b": "\\", "h": "#", "l": "<"}[m[1]], reply) == ODD


def test_long_conversation_positions(spark):
    rows = [(9, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(3000)]
    table = cf.format_table(turns(spark, rows)).orderBy("pos").collect()
    at = 0
    for k, r in enumerate(table):
        assert (r["pos"], r["turn"], r["start"]) == (k, k, at)
        at = r["end"]


def test_many_unclosed_tags_are_text_in_linear_time():
    page = "<p>one</p>" + "<a " * 200_000
    found = he.blocks(page)
    assert [t for t, _, _ in found] == ["one", ("<a " * 200_000).strip()]
    assert [t for t, _, _ in he.blocks("<p>one</p><!-- two")] == ["one"]


def test_markup_without_an_end_does_not_cut_the_page():
    words = "The river rose for three days before the old bridge gave way to the water. "
    article = "<article><h1>The flood</h1><p>" + words * 3 + "</p><p>" + words * 2 + "</p></article>"
    text = "The flood\n\n" + "\n\n".join(" ".join((words * k).split()) for k in (3, 2))
    head = "<!doctype html><html><head><meta charset=utf-8><title>T</title><style>p {}</style>"
    crf = he.model()
    plain = head + "</head><body><main>" + article + "</main></body></html>"
    assert he.main_text(plain, crf) == text
    for page in (plain.replace("</head>", ""), plain.replace("</head><body>", ""),
                 plain.replace("</head>", "").replace("</article>", "<script>s = '</head>'</script></article>")):
        assert he.main_text(page, crf) == text, page
    pieces = ["<svg class=i viewBox='0 0 1 1'/>", "<math/>", "<noscript>Turn it on", "<select><option>one<option>two",
              "<object data=x>No plug-in", "<iframe src=x />", "<template><b>x</b>", "<svg><path d='M0'>",
              "<svg><svg/><svg></svg><text>Label</text></svg>", "<object><object>a</object>b</object>",
              "<noscript><p>Turn it on</p></noscript>", "<div><select><option>one</div>"]
    for piece in pieces:
        for later in ("", "<noscript>n</noscript><select></select><object></object><svg></svg><iframe></iframe>"
                          "<template></template>"):
            for page in (plain.replace("<main>", "<main>" + piece), plain.replace("<p>", piece + "<p>", 1)):
                assert he.main_text(page.replace("</main>", later + "</main>"), crf) == text, (piece, later)


def test_formulas_are_text():
    page = ("<p>Here <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding='application/x-tex'>x + 1</annotation>"
            "</math> grows<svg><title>i</title></svg>.</p>")
    assert [t for t, _, _ in he.blocks(page)] == ["Here x+1 grows."]


def test_many_unclosed_hidden_elements_are_read_in_linear_time():
    for piece in ("<svg>", "<noscript>", "<object ", "<select><p>a"):
        he.blocks(piece * 100_000)


def test_unclosed_paragraphs_end_however_deep_their_markup():
    def bits(page):
        return {t: {n for i, n in enumerate(he.NAMES) if b >> i & 1} for t, b, _ in he.blocks(page)}
    for depth in (0, 3, 12, 500):
        got = bits("<p class=ad>buy" + "<i>" * depth + " now<h2>Title</h2><p>Text</p>")
        assert "class:ad" not in got["Title"] | got["Text"] and "in:p" not in got["Title"]
    # a cell ends the paragraph of the cell before it; an inner list does not end the outer item
    got = bits("<table><tr><td><p class=ad>a<div>b</div><td>c</table>")
    assert "class:ad" not in got["b"] | got["c"]
    got = bits("<ul class=ad><li>one<ul><li>two<li>three</ul><li>four</ul><p>five</p>")
    assert all("class:ad" in got[k] for k in ("one", "two", "three", "four")) and "class:ad" not in got["five"]


def test_deep_nesting_is_read_in_linear_time():
    start = time.time()
    assert [t for t, _, _ in he.blocks("<div>" * 200_000 + "end" + "<p>" * 100_000)] == ["end"]
    assert time.time() - start < 20
