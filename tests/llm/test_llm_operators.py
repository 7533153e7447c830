"""Each operator against its plain counterpart, on hostile small tables."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import DOC_SCHEMA, contamination, doc_frame, edits, gone_lines, jaccard_components, quality_measures, repeats, shingles
from pyspark.sql import functions as F

from spanmill.llm import chat, decontaminate, html_text, jaccard, licenses, line_dedup, packing, quality, repeats as repeats_op, token_files
from spanmill.llm.range_coder import BrokenBlock, decode_blocks, encode_blocks
from spanmill.llm.tokenizing import encoder
from spanmill.session import work_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DRAW = random.Random(3)
VOCABULARY = ["".join(DRAW.choices("abcdefghijklmnop", k=DRAW.randint(2, 7))) for _ in range(400)]


def sentence(n, draw=DRAW):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def changed(text, n, draw=DRAW):
    words = text.split(" ")
    for i in draw.sample(range(len(words)), n):
        words[i] = draw.choice(VOCABULARY)
    return " ".join(words)


def hostile_docs():
    base, passage = sentence(300), sentence(60)
    docs = [None, "", " \n\t ", "word", "Word", "a b c", "A B c", "é ß x", base, base, changed(base, 3), changed(base, 20), changed(base, 150)]
    docs += [changed(base, 2) for _ in range(40)]
    docs += [f"{sentence(30)}\n{passage}\n{sentence(40)}" for _ in range(30)]
    docs += [sentence(6) for _ in range(5)] + [sentence(12)] * 3 + [passage[:k] for k in (50, 99, 100, 101, 160)]
    docs += ["ab" * 400, "x" * 350, "ein Satz. " * 120, "\n".join(["the same line of this text"] * 9), "😀é" * 90 + sentence(20)]
    small = sentence(14)
    docs += [small, small + " one", "one " + small, small.rsplit(" ", 1)[0], sentence(4000) + " " + base]
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def hostile():
    return hostile_docs()


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_jaccard_equals_all_pairs(spark, hostile):
    expected = jaccard_components(hostile)
    assert by_id(jaccard.jaccard_classes(doc_frame(spark, hostile, extra=True))) == expected


def test_jaccard_crowded_signatures_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 2)
    common = sentence(90)
    docs = [f"{common} {sentence(k)}" for k in range(5, 45) for _ in range(2)]
    docs += [changed(d, 4) for d in docs[::3]]
    docs = list(enumerate(docs))
    assert by_id(jaccard.jaccard_classes(doc_frame(spark, docs))) == jaccard_components(docs)


def test_jaccard_repeated_and_missing_ids(spark):
    text = sentence(30)
    found = sorted(rows(jaccard.jaccard_classes(doc_frame(spark, [(5, text), (5, text), (None, text), (9, text), (7, None), (None, "")]))), key=str)
    assert found == sorted([(5, 26, 5), (5, 26, 5), (None, 26, None), (9, 26, 5), (7, 0, 7), (None, 0, None)], key=str)


def test_texts_that_share_an_id_are_told_apart(spark):
    """Links are verified on the right text, and one row of each class stays."""
    base, other = sentence(100), sentence(100)
    near, far = changed(base, 1), changed(other, 1)
    docs = [(1, base), (2, base), (2, other), (2, near), (3, far), (5, "x y"), (5, "x y"), (None, "p q r"), (None, "p q r"), (None, base), (7, ""), (7, None), (8, " ")]
    found = sorted(rows(jaccard.jaccard_classes(doc_frame(spark, docs))), key=str)
    size = len(set(shingles(base)))
    assert [r for r in found if r[0] in (1, 2, 3)] == sorted([(1, size, 1), (2, size, 1), (2, len(set(shingles(other))), 2), (2, len(set(shingles(near))), 1), (3, len(set(shingles(far))), 2)], key=str)
    clashing = doc_frame(spark, docs).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("key", "row", "class", "a.b", "first", "text_hash", "node"))))
    kept = jaccard.first_of_each(clashing)
    assert kept.columns == clashing.columns
    kept = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept == sorted([(1, base), (2, other), (5, "x y"), (None, "p q r"), (7, ""), (7, None), (8, " ")], key=str)


def test_lines_pass_columns_of_any_name(spark):
    line = "a line that stands in this table twice"
    docs = doc_frame(spark, [(1, line), (2, f"{line}\nand another line that is its own")])
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("place", "removed", "row", "_place", "_removed", "no", "a.b"))))
    found = line_dedup.dedup_lines(docs)
    assert found.columns == docs.columns
    assert sorted(tuple(r)[-7:] for r in found.collect()) == [tuple(range(7))] * 2
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, line), (2, "and another line that is its own")]


def test_repeats_equal_brute_force(spark, hostile, monkeypatch):
    expected = repeats(hostile)
    assert by_id(repeats_op.repeat_report(doc_frame(spark, hostile, extra=True))) == expected
    monkeypatch.setattr(repeats_op, "CROWD", 2)
    monkeypatch.setattr(repeats_op, "SORTED", 50)
    assert by_id(repeats_op.repeat_report(doc_frame(spark, hostile))) == expected
    kept = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in repeats_op.remove_repeats(doc_frame(spark, hostile)).collect()}
    assert kept == {i: v[3] for i, v in expected.items()}


def test_previous_factors_equal_brute_force():
    draw = random.Random(8)
    for _ in range(300):
        texts = ["".join(draw.choices("ab", k=draw.randint(0, 25))) for _ in range(draw.randint(1, 4))]
        suffixes = sorted((text[k:], d, k) for d, text in enumerate(texts) for k in range(len(text)))
        place = np.array([d * 100 + k for _, d, k in suffixes], np.int64)
        if draw.random() < 0.3 and len(place):
            place[draw.randrange(len(place))] = place[0]

        def shared(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        common = np.array([shared(suffixes[i - 1][0], s[0]) if i else 0 for i, s in enumerate(suffixes)], np.int64)
        want = [max((shared(s[0], t[0]) for t, p in zip(suffixes, place) if p < place[i]), default=0) for i, s in enumerate(suffixes)]
        assert repeats_op.previous_factors(place, common).tolist() == want


def test_a_passage_of_a_third_of_all_documents(spark, monkeypatch):
    """Every document holds it between words of its own, so nothing folds before the groups."""
    passage = sentence(30)
    docs = [(i, f"{sentence(4)} {i} {passage} {i} {sentence(4)}" if i % 3 == 0 else sentence(20)) for i in range(300)]
    expected = repeats(docs)
    assert sum(v[2] > 0 for v in expected.values()) >= 99
    for crowd in (20_000, 20):
        monkeypatch.setattr(repeats_op, "CROWD", crowd)
        assert by_id(repeats_op.repeat_report(doc_frame(spark, docs))) == expected


def test_repeats_of_texts_that_share_an_id(spark):
    """Each text loses its own repeats only; repeated rows are one document."""
    t, u, v = sentence(80), sentence(80), sentence(80)
    docs = [(1, t), (2, t), (2, u), (2, u), (3, f"{v} {u}"), (2, v)]
    found = sorted((r.doc_id, bytes(r.kept).decode(), r.n_removed, r.n_spans) for r in repeats_op.remove_repeats(doc_frame(spark, docs)).collect())
    size = len(t.encode())
    assert found == sorted([(1, t, 0, 0), (2, "", size, 1), (2, u, 0, 0), (2, u, 0, 0), (2, v, 0, 0), (3, " ", len(u) + len(v), 2)])


def test_repeats_without_ids_stay_whole(spark):
    text = sentence(60)
    found = rows(repeats_op.repeat_report(doc_frame(spark, [(None, text), (None, text), (3, text), (3, text), (4, text)])))
    assert sorted((r[0] or -1, r[2]) for r in found) == [(-1, 0), (-1, 0), (3, 0), (3, 0), (4, len(text.encode()))]


def test_lines_of_texts_that_share_an_id(spark):
    """Each text loses its own lines only; of several texts with one id the one with the smaller hash is earlier."""
    one, two, three = (f"a line with the number {k} and words enough" for k in ("one", "two2", "three33"))
    docs = [(1, f"{one}\nown of the first text of this id"), (1, f"own of the other text of this id\n{one}"), (2, f"{two}\n{one}"), (2, f"own line of the text\n{two}"), (2, f"own line of the text\n{two}"),
            (None, f"{three}\n{two}"), (None, f"{three}\nquite another line than those above")]
    hashed = [(r.doc_id, r.h, r.text) for r in doc_frame(spark, docs).selectExpr("doc_id", "xxhash64(text) AS h", "text").collect()]
    seen, want = set(), {}
    for _, h, text in sorted(set(hashed), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        left = []
        for line in text.split("\n"):
            if line not in seen:
                left.append(line)
                seen.add(line)
        want[text] = "\n".join(left)
    kept = sorted(r.text for r in line_dedup.dedup_lines(doc_frame(spark, docs)).collect())
    assert kept == sorted(want[text] for _, text in docs)
    report = sorted((r.doc_id or 9, r.n_removed) for r in line_dedup.line_report(doc_frame(spark, docs)).collect())
    assert report == sorted((i or 9, text.count("\n") + 1 - (want[text].count("\n") + 1 if want[text] else 0)) for i, text in docs)


def line_docs():
    lines = [sentence(8) for _ in range(12)]
    typo = lambda s, k: s[:k] + "#" + s[k + 1 :]
    docs = [None, "", "\n".join(lines[:6]), "\n".join([lines[0], "short", typo(lines[1], 5), lines[6]]), "short\nshort", f"{lines[7]}\n{lines[7]}\n{lines[7]}x"]
    docs += [f"{lines[8][:k]}{c}{lines[8][k:]}" for k in range(0, 30, 3) for c in ("", "q", "é")]
    docs += [typo(typo(lines[9], 3), 9), lines[9], typo(lines[9], 3), lines[10][1:], lines[10], lines[10][:-1], "é" * 25, "é" * 24 + "e", "é" * 26]
    docs += [f"item number {k:05d} of a long list" for k in range(0, 3000, 37)]
    return list(enumerate(docs))


def test_lines_equal_brute_force(spark):
    docs = line_docs()
    expected = gone_lines(docs)
    report = {r.doc_id: [int(n) for n in r.removed.split(",") if n] for r in line_dedup.line_report(doc_frame(spark, docs, extra=True)).collect()}
    assert report == expected
    kept = by_id(line_dedup.dedup_lines(doc_frame(spark, docs, extra=True)))
    for i, text in docs:
        left = None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if no not in set(expected[i]))
        assert kept[i][0] == left


def test_lines_within_two_edits(spark):
    docs = line_docs()
    found = {r.doc_id: [int(n) for n in r.removed.split(",") if n] for r in line_dedup.line_report(doc_frame(spark, docs), max_edits=2).collect()}
    assert found == gone_lines(docs, max_edits=2)


def test_automaton_of_edits(spark):
    draw = random.Random(5)
    pairs = [("", ""), ("", "a"), ("a", "b")]
    for _ in range(200):
        a = "".join(draw.choices("abé", k=draw.randint(1, 12)))
        b = list(a)
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "a"])
        pairs.append(tuple(sorted((a, "".join(b)), key=len)))
    for bound in (1, 2, 3):
        fitting = [p for p in pairs if len(p[1]) - len(p[0]) <= bound]
        df = spark.createDataFrame(fitting, "s string, r string").select("s", "r", line_dedup.within(F.col("s"), F.col("r"), bound).alias("w"))
        assert all(r.w == (edits(r.s, r.r) <= bound) for r in df.collect())


def test_quality_measures(spark, hostile):
    found = by_id(quality.judge(doc_frame(spark, hostile, extra=True)).select("doc_id", *quality.MEASURES, "base_failed", "kept"))
    for i, text in hostile:
        assert found[i][:6] == quality_measures(text)
        assert not (found[i][5] and found[i][6])
    kept = {r.doc_id for r in quality.keep_good(doc_frame(spark, hostile, extra=True)).collect()}
    assert kept == {i for i, v in found.items() if v[6]}


def test_quality_model_parts_junk_from_clean():
    draw = np.random.default_rng(1)
    n = 4000
    cast = np.where(draw.random((n, len(quality.RULES))) < 0.95, 1, 0)
    junk = np.arange(n) < 400
    for i in np.flatnonzero(junk):
        cast[i, i % 4] = 2
    cast[draw.random((n, len(quality.RULES))) < 0.002] = 2
    patterns, counts = np.unique(quality.encode(cast), return_counts=True)
    model = quality.fit(patterns, counts)
    good = model.posterior(cast) >= 0.5
    assert good[~junk].mean() > 0.98 and good[junk].mean() < 0.02
    assert all(a > 0.5 for a in model.accuracies().values())
    clean, ones = np.unique(quality.encode(cast[~junk & (cast != 2).all(1)]), return_counts=True)
    assert (quality.fit(clean, ones).posterior(quality.decode(clean)) > 0.9).all()


def test_contamination_equals_brute_force(spark, hostile, monkeypatch):
    passage = hostile[60][1]
    items = [(1, passage), (2, sentence(30)), (10, "word"), (11, " . "), (12, None), (13, "A b, C"), (14, sentence(9)), (14, sentence(9))]
    docs = [*hostile, (900, sentence(20) + " " + items[1][1] + " " + sentence(5)), (901, f"x {items[6][1]} y {items[6][1]}"), (902, items[1][1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def check():
        found = by_id(decontaminate.contamination(doc_frame(spark, docs, extra=True), bench))
        for i, text in docs:
            n, hit, met = contamination(text, items)
            assert found[i] == (n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0)

    check()
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 40)
    check()
    clean = by_id(decontaminate.decontaminate(doc_frame(spark, docs, extra=True), bench))
    for i, text in docs:
        n, hit, _ = contamination(text, items)
        assert (i in clean) == (hit <= decontaminate.COVERAGE * n)
        if not hit:
            assert clean[i][0] == text
        elif i in clean:
            assert contamination(clean[i][0], items)[0] == n - hit


def packed(spark, docs):
    pieces = packing.pack_pieces(doc_frame(spark, docs, extra=True), BYTES).collect()
    own = encoder(BYTES, True).tokenizer
    for i, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [x for p in mine for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        at = 0
        for p in mine:
            assert (p.start, p.doc_tokens, len(p.ids)) == (at, len(ids), 4 * p.length)
            at += p.length
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    return padding, sum(p.length for p in pieces)


def test_packing_keeps_every_id_once(spark, hostile):
    spaced = ["a  b", "a   b", " a\n\n\nb ", "x \n y", "tab\tbed \t end", "it's 'quoted' 12,5.", "nbsp  x", "\n", "  ", "w, x. y! ...", "<|endoftext|> z"]
    padding, ids = packed(spark, [*hostile, *((1000 + k, t) for k, t in enumerate(spaced))])
    assert padding < 0.02 * ids + packing.SIZE


def test_best_cuts_are_the_cheapest():
    draw = random.Random(9)
    for _ in range(30):
        places = sorted({0, *draw.sample(range(1, 400), 25)})
        while max(b - a for a, b in zip(places, places[1:], strict=False)) > 100:
            places = sorted({*places, *range(0, places[-1], 90)})
        cost = [draw.choice([0.0, 1.0, 6.0]) for _ in places]
        pad = lambda n: 0 if n >= packing.SHORTEST and n & (n - 1) == 0 else 128 - n
        best = [0.0]
        for j in range(1, len(places)):
            best.append(min(best[i] + pad(places[j] - places[i]) for i in range(j) if places[j] - places[i] <= 128) + cost[j] + packing.OPENING)
        ends = packing.best_cuts(places, cost, 128)
        total = sum(pad(b - a) + cost[places.index(b)] + packing.OPENING for a, b in zip([0, *ends], ends, strict=False))
        assert ends[-1] == places[-1] and abs(total - best[-1]) < 1e-9


def test_token_files_round_trip(spark, hostile):
    docs = [*hostile, (None, "no id"), (7, "same id"), (2000, "ΑΣ Σ ÉCLAIR don't é <|startoftext|>")]
    path = work_path(spark, "tokens")
    token_files.write_token_files(doc_frame(spark, docs, extra=True), path, WORDS, 2)
    found = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    own = encoder(WORDS, False).tokenizer
    at, left = 0, {}
    for i, text in docs:
        left.setdefault(i, []).append([*own.encode(text or "", add_special_tokens=False).ids, 2])
    assert [r.doc_id for r in found] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        left[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
        at += r.n_tokens


def test_range_coder():
    draw = np.random.default_rng(4)
    blocks = [np.zeros(0, np.uint32), np.array([5], np.uint32), np.full(3000, 65535, np.uint32), draw.integers(0, 65536, 4096).astype(np.uint32)]
    blocks += [np.cumsum(draw.integers(0, 3, n)).astype(np.uint32) % 50 for n in (1, 10, 900, 4096)]
    coded = encode_blocks(blocks, 65536)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, decode_blocks(coded, 65536), strict=True))
    assert len(coded[2]) < 300 and len(coded[7]) < 4096 * 2 * 0.8
    torn = bytearray(coded[3])
    torn[200] ^= 1
    with pytest.raises(BrokenBlock):
        decode_blocks([bytes(torn)], 65536)


def test_pages():
    page = (
        "<html><head><title>t</title><script>var a='</p><p>no';</script><style>p{}</style></head><body class='has-sidebar'><header>top</header><nav><ul><li>one"
        "<li>two</ul></nav><div class=\"ad-box\">buy</div><main><h1>Head &amp; line</h1><p>First <b>bold</b>\n  text&nbsp;here<p>Second<br>line"
        "<aside>side</aside><ul><li>a</li><li>b</ul><form>f</form><!-- <p>c</p> --><div id=comments><p>said</div></main><footer>end</footer>"
    )
    assert html_text.main_text(page) == "Head & line\n\nFirst bold text here\n\nSecond line\n\na\n\nb"
    plain = "<body><div>menu</div><div><p>" + "long words here " * 20 + "</p><p>more</p></div>"
    assert html_text.main_text(plain).endswith("here\n\nmore")
    for torn in (None, "", "<", "<p", "text only", "<p class='x>y</p>", "<article>", "</p></div>", "<!-- open", "<script>x", "a < b & c"):
        html_text.main_text(torn)


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é x</article>", "e"), (None, None, None, "e"), (1, "u", "<article><p>é x</article>", "e")], "page_id bigint, url string, html string, text string")
    assert sorted(rows(html_text.extract_text(df)), key=str) == sorted([(1, "u", "é x", 3), (None, None, "", 0), (1, "u", "é x", 3)], key=str)


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 60)
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "\\", "", None, "a\nb", "<<||>>", "<\\\\|x"]
    turns = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, 0, None, "x"), (None, 0, "assistant", "y"), (3, 1, "a\nb\\", "z"), (3, 1, "user", "w"), (3, None, "assistant", "v")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn bigint, role string, text string, segment string")
    found = by_id(chat.read_back(chat.format_conversations(df)))
    groups = {}
    for conv, turn, role, text in turns:
        groups.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    for conv, own in groups.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        spoken = "".join(f"{r}\n{t}\n" for _, r, t in own)
        assert found[conv][:4] == (len(own), hashlib.sha256(spoken.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_template_language():
    render = lambda source, **scope: "".join(t for t, _ in chat.compile_template(source)(scope))
    assert render("{% for x in xs %}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=["a", "b"]) == "a, b"
    assert render("{% set a = 'x' + 'y' %}{{ a | upper }}{# no #}{% if a == 'xy' and b %}1{% elif a in 'xyz' %}2{% else %}3{% endif %}", b=False) == "XY2"
    assert render("{{ m.__class__ }}{{ m['k'] }}{{ xs[1] }}{{ none }}", m={"k": "v"}, xs=(1, 2)) == "v2"
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if true and not false %}d{% else %}e{% endif %}{{ 1 + 2 }}"))
    assert folded == (chat.Output(chat.Const("abcd3")),)
    assert list(chat.compile_template("x{% generation %}y{{ z }}{% endgeneration %}")({"z": "!"})) == [("x", False), ("y", True), ("!", True)]
    for wrong in ("{% for x %}{% endfor %}", "{{ a | open }}", "{{ a() }}", "{% if a %}", "{% import os %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)


def test_licences(spark):
    lines = {
        "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    }
    docs = [(k, f"{sentence(20)}\n{line} {sentence(9)}") for k, line in enumerate(lines.values())]
    docs += [(10, "\n".join(lines.values())), (11, None), (12, ""), (13, "the general public was under the version"), (14, sentence(50)), (0, docs[0][1]), (None, lines["mit"])]
    found = sorted(rows(licenses.licence_report(doc_frame(spark, docs, extra=True))), key=str)
    expected = [(k, 2, 1, name) for k, name in enumerate(lines)] + [(10, 4, 4, "apache,cc-by-nc,gpl,mit"), (11, 0, 0, ""), (12, 0, 0, ""), (13, 1, 0, ""), (14, 1, 0, ""), (0, 2, 1, "mit"), (None, 1, 1, "mit")]
    assert found == sorted(expected, key=str)


def test_short_notice_is_a_licence(spark):
    docs = [(0, f"{sentence(20)}\nAll rights reserved."), (1, f"All rights reserved. {sentence(9)}"), (2, "all rights of the reserved"), (3, sentence(12))]
    assert sorted(rows(licenses.licence_report(doc_frame(spark, docs)))) == [(0, 2, 1, "reserved"), (1, 1, 1, "reserved"), (2, 1, 0, ""), (3, 1, 0, "")]


def test_wrapped_notices_are_licences(spark):
    def wrapped(text, width, mark=""):
        return "\n".join(mark + line for line in textwrap.wrap(text, width))

    texts = {
        "mit": licenses.TEMPLATES["mit"][1], "bsd": licenses.TEMPLATES["bsd"][1], "gpl": licenses.TEMPLATES["gpl"][1],
        "cc-by-sa": licenses.TEMPLATES["cc-by-sa"][1], "agpl": licenses.TEMPLATES["agpl"][1],
    }
    docs, expected = [], []
    for family, text in texts.items():
        for width, mark in ((72, ""), (64, " * "), (60, "# "), (66, "rem ")):
            docs.append((len(docs), f"{sentence(9)}\n{mark}\n{wrapped(text, width, mark)}\n{mark and '//'}\n{sentence(9)}"))
            expected.append((1, family))
    # One block: code, two wrapped notices and a line that is one, without a line between them.
    docs.append((len(docs), "\n".join([*(sentence(7) for _ in range(60)), wrapped(texts["mit"], 50), wrapped(texts["bsd"], 50), "All rights reserved.", sentence(9)])))
    expected.append((3, "bsd,mit,reserved"))
    docs.append((len(docs), wrapped(texts["mit"], 72).replace("\n", f"\n\n{sentence(5)}\n\n")))
    expected.append((0, ""))
    found = {r.doc_id: (r.n_licensed, r.families) for r in licenses.licence_report(doc_frame(spark, docs)).collect()}
    assert [found[k] for k in range(len(docs))] == expected


def test_unknown_examples_hold_no_notice(spark):
    notice, tail = "This work is licensed under the GNU General Public License, version 3.", sentence(500)
    docs = [(k, notice) for k in range(60)] + [(k, f"{sentence(8)} {k} {tail}") for k in range(60, 120)]
    drawn = [r.text for r in licenses.unknown_examples(doc_frame(spark, docs), 20).collect()]
    assert len(drawn) == 20 and notice not in drawn and all(t.endswith(tail) for t in drawn)
    assert drawn != [t for _, t in docs[60:80]]
    model = licenses.train(doc_frame(spark, docs), 50)
    assert model.family(notice) == "gpl"


def test_licence_model_on_held_out_variants(spark):
    model = licenses.train(doc_frame(spark, [(1, sentence(200))]))
    held = licenses.variants(99, 9)
    assert sum(model.family(text) == family for family, text in held) > 0.95 * len(held)
    judged = {r.no: (r.family, round(r.probability, 6)) for r in licenses.scan(doc_frame(spark, [(1, "\n".join(t for _, t in held))]), model).collect()}
    for no, (_, text) in enumerate(held):
        family = model.family(text)
        assert (no in judged) == (family != licenses.UNKNOWN)
        if no in judged:
            assert judged[no] == (family, round(model.probabilities(text)[licenses.FAMILIES.index(family)], 6))


@pytest.mark.parametrize("run", [
    lambda s, d: jaccard.jaccard_classes(d), lambda s, d: repeats_op.repeat_report(d), lambda s, d: repeats_op.remove_repeats(d),
    lambda s, d: line_dedup.line_report(d), lambda s, d: line_dedup.dedup_lines(d), lambda s, d: quality.judge(d), lambda s, d: quality.keep_good(d),
    lambda s, d: decontaminate.contamination(d, s.createDataFrame([], "item_id bigint, text string")), lambda s, d: packing.pack_pieces(d, BYTES),
    lambda s, d: token_files.token_report(d, work_path(s, "none"), WORDS, 2), lambda s, d: licenses.licence_report(d),
    lambda s, d: html_text.extract_text(d.selectExpr("doc_id page_id", "lang url", "text html")),
    lambda s, d: chat.read_back(chat.format_conversations(d.selectExpr("doc_id conv_id", "doc_id turn", "lang role", "text"))),
])
def test_empty_tables(spark, run):
    assert run(spark, spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_crc_of_pieces(spark):
    found = rows(packing.with_digest(packing.pack_pieces(doc_frame(spark, [(1, "a b")]), BYTES)))
    ids = [*encoder(BYTES, True).tokenizer.encode("a b", add_special_tokens=False).ids, 0]
    assert found == [(1, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids), 0, 0)]
