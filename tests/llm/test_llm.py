"""The corpus operators against brute force, exact round trips and held-out cases; nulls, empties, ties, repeats, clashing names."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import align, bitext, broken, containers, defects, encode, language, mixing, normalize, pieces, scans, subjects

TOKENIZER = Path(encode.DEFAULT_RANKS)
needs_tokenizer = pytest.mark.skipif(not TOKENIZER.exists(), reason="no tokenizer files")
LIMITS = [("paragraph", "characters", 100, 10), ("context", "characters", 50, 5), ("chunk", "words", 20, 0)]
PARA = "row_id long, project_id string, chapter_id string, para_id string, original_text string, translated_text string, status string, tag string, para_index int, provider string"


def paras(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"row_id": i, "project_id": "p", "chapter_id": "c", "para_id": f"x{i}", "original_text": "", "translated_text": "", "status": "done", "tag": "p", "para_index": i, "provider": "lumen"} | r
        full.append(tuple(d[c.split()[0]] for c in PARA.split(", ")))
    return spark.createDataFrame(full, PARA)


# 1 ---------------------------------------------------------------------------------------------


def words_text(n, seed=1):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["alpha", "be", "gamma", "delta"]) + rnd.choice([" ", " ", ". ", ", ", "\n", "\n\n"]) for _ in range(n)).strip()


@pytest.mark.parametrize("text,limit,overlap", [(words_text(400), 100, 10), ("x" * 1000, 100, 10), ("é" * 99 + " " + "y" * 500, 100, 0), (words_text(60_000, 3), 3000, 200)])
def test_pieces_fit_overlap_and_rebuild(spark, text, limit, overlap):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = sorted(pieces.split_items(df, ["k"], limit, overlap).collect(), key=lambda r: r.piece_no)
    assert all(len(r.piece) <= limit for r in got)
    assert all(b.start_offset == a.end_offset - overlap for a, b in zip(got, got[1:]))
    assert got[0].piece + "".join(r.piece[overlap:] for r in got[1:]) == text
    if "alpha" in text:
        assert all(r.boundary != "none" for r in got[:-1])


def test_pieces_found_counts_items_not_pieces(spark):
    p = paras(spark, [{"original_text": "a" * 100}, {"original_text": " \n" + "b" * 101 + " "}, {"original_text": " " * 300}, {"original_text": None}])
    c = spark.createDataFrame([(7, ["x" * 51, None, "y" * 50]), (8, None), (9, [])], "chunk_row_id long, context_before array<string>")
    lim = spark.createDataFrame(LIMITS, "item_kind string, size_unit string, max_size int, overlap_size int")
    assert sorted(map(tuple, pieces.found(p, c, lim).collect())) == [("context", 7, 0), ("paragraph", 1, 0)]
    assert pieces.fits(pieces.split_by_limits(p, c, lim).filter("item_kind = 'paragraph'"), 100).count() == 0
    assert pieces.found(p.limit(0), c.limit(0), lim).count() == 0


def test_items_of_many_ranges_are_cut_as_planned_over_all_boundaries(spark, monkeypatch):
    rnd = random.Random(11)
    monkeypatch.setattr(pieces, "RANGE", 1 << 16)  # workers keep the module's own value
    texts = [words_text(30_000, k) for k in range(2)] + ["a" + " " * 200 + words_text(20_000, 9), "語" * 70_000, "x. " + "\n" * 66_000 + "end"]
    texts += ["".join(rnd.choice("ab .,\n") for _ in range(140_000)).strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in pieces.split_items(df, ["k"], 2000, 100).collect():
        got.setdefault(r.k, []).append((r.piece_no, r.start_offset, r.end_offset, r.boundary, r.piece))
    for k, text in enumerate(texts):
        found = pieces.boundaries(text, 0, len(text))
        want = pieces.plan(len(text), np.array([o for o, _ in found]), np.array([s for _, s in found]), 2000, 100)
        assert sorted(got[k]) == [(i, a, b, pieces.KIND[s], text[a:b]) for i, (a, b, s) in enumerate(want)]


@pytest.mark.parametrize("overlap", [0, 90])
def test_files_are_cut_by_ranges_without_losing_a_byte(spark, tmp_path, overlap):
    text = words_text(5000, 5) + "ß" * 700 + "川は流れる。雨が降った。" * 300
    (tmp_path / "f.txt").write_text(text, encoding="utf-8")
    got = sorted(pieces.split_files(spark, [str(tmp_path / "f.txt")], 1000, overlap, range_bytes=4096, halo=64).collect(), key=lambda r: r.piece_no)
    raw = text.encode()
    assert all(r.end_offset - r.start_offset <= 1000 and raw[r.start_offset : r.end_offset].decode() == r.piece for r in got)
    assert got[0].start_offset == 0 and got[-1].end_offset == len(raw)
    assert all(overlap <= a.end_offset - b.start_offset <= overlap + 3 for a, b in zip(got, got[1:]))
    assert all(r.piece.endswith("。") for r in got[-8:-1])


# 2, 3, 4: a small bilingual world -------------------------------------------------------------

NOUNS = [("the lantern", "chiếc đèn lồng"), ("the old bridge", "cây cầu cũ"), ("the compiler", "trình biên dịch"), ("the river", "dòng sông"), ("the letter", "bức thư"), ("the harbor", "bến cảng")]
FORMS = [("{a} is harder to explain than {b}", "{x} khó giải thích hơn {y}"), ("nobody believed in {a} near {b}", "không ai tin vào {x} gần {y}"), ("a message explained {a} and {b}", "một tin nhắn giải thích về {x} và {y}")]
TAILS = [("", ""), (" despite the rain", " bất chấp cơn mưa"), (" with great care", " một cách hết sức cẩn thận")]


def sentence(rnd):
    (a, x), (b, y) = rnd.sample(NOUNS, 2)
    (e, v), (te, tv) = rnd.choice(FORMS), rnd.choice(TAILS)
    o, t = e.format(a=a, b=b) + te, v.format(x=x, y=y) + tv
    return o[0].upper() + o[1:] + ".", t[0].upper() + t[1:] + "."


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        pairs = [sentence(rnd) for _ in range(rnd.choice([1, 1, 2, 3]))]
        rows.append({"original_text": " ".join(o for o, _ in pairs), "translated_text": " ".join(t for _, t in pairs)})
    return rows


FOREIGN = [
    ("fr", "La porte est plus difficile à expliquer que le pont et personne ne croyait au message près du port malgré la pluie du soir"),
    ("de", "Die Tür ist schwerer zu erklären als die Brücke und niemand glaubte an die Nachricht am Hafen trotz des Regens am Abend"),
    ("es", "La puerta es más difícil de explicar que el puente y nadie creía en el mensaje cerca del puerto a pesar de la lluvia"),
]


@pytest.fixture(scope="module")
def docs(spark, world):
    rows = [(" EN", r["original_text"]) for r in world] + [("vi", r["translated_text"]) for r in world] + FOREIGN + [(None, "x y"), ("en", None)]
    rows += [("vi", "Rất tiếc, tôi không thể dịch đoạn văn này vào lúc này."), ("en", "I am sorry, this passage was not translated and must stay untouched, outside what we may handle, and there was more of it that we had.")]
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.fixture(scope="module")
def lexicon(spark, world):
    return bitext.learn(paras(spark, world))


def test_lexicon_knows_nouns(lexicon):
    assert {"đèn lồng", "chiếc đèn"} <= set(lexicon.entries["lantern"])


def test_broken_translations(spark, world, docs):
    cut = [
        {"original_text": "The lantern is harder to explain than the river.", "translated_text": "Chiếc đèn lồng khó giải th"},
        {"original_text": "The river is harder to explain than the old bridge.", "translated_text": "Dòng sông khó giải thích hơn cây"},
        {"original_text": "Nobody believed in the letter near the harbor despite the rain.", "translated_text": "Không ai tin vào bức thư gần bến cảng bất", "status": "error"},
    ]
    whole = [
        {"original_text": "The lantern is harder to explain than the river.", "translated_text": "Chiếc đèn lồng khó giải thích hơn dòng sông"},
        {"original_text": "The lantern is harder to explain than the river…", "translated_text": "Chiếc đèn lồng khó giải thích hơn dòng sông…"},
        {"translated_text": None, "original_text": None},
        {"translated_text": "  ", "original_text": "The river."},
    ]
    df = paras(spark, world + cut + whole)
    assert sorted(r.row_id for r in broken.found(df, docs).collect()) == [400, 401, 402]
    rep = broken.report(df, docs).collect()[0]
    assert (rep.cut_off, rep.translations) == (3, 405)
    assert broken.found(df.limit(0), docs).count() == 0


def test_strict_prefixes_equal_brute_force(spark):
    rnd = random.Random(1)
    vals = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 18))).strip() or "a" for _ in range(600)})
    df = spark.createDataFrame([(v,) for v in vals], "value string")
    want = {v for v in vals if any(w != v and w.startswith(v) for w in vals)}
    assert {r.value for r in broken.strict_prefixes(df, df).collect()} == want


DICTIONARY = {
    "lantern": "chiếc đèn lồng", "bridge": "cây cầu cũ", "compiler": "trình biên dịch", "river": "dòng sông", "letter": "bức thư", "harbor": "bến cảng", "harder": "khó giải thích", "nobody": "không ai",
    "believed": "tin vào", "message": "một tin nhắn", "explained": "giải thích về", "rain": "cơn mưa", "care": "hết sức cẩn thận", "great": "hết sức cẩn thận",
}


def test_alignment_orders_omissions_and_mergers():
    lexicon = bitext.trim_lexicon(bitext.Lexicon({w: dict.fromkeys(bitext.pairs(t.split()), 1.0) for w, t in DICTIONARY.items()}, dict.fromkeys(DICTIONARY, 3.5)))
    o = "The lantern is harder to explain than the river. Nobody believed in the letter near the harbor. A message explained the compiler and the old bridge with great care."
    assert align.align(o, "Một tin nhắn giải thích về trình biên dịch và cây cầu cũ một cách hết sức cẩn thận. Chiếc đèn lồng khó giải thích hơn dòng sông.", lexicon) == [(0, 1), (2, 0)]
    assert align.align(o, "Chiếc đèn lồng khó giải thích hơn dòng sông, còn không ai tin vào bức thư gần bến cảng. Ai cũng biết chuyện đó.", lexicon) == [(0, 0), (1, 0)]
    assert align.align(o, "Một tin nhắn giải thích về trình biên dịch và cây cầu cũ. Việc đó diễn ra một cách hết sức cẩn thận.", lexicon) == [(2, 0), (2, 1)]
    assert align.align(None, "x", lexicon) == [] and align.align("a.", " ", lexicon) == []


def test_chains_keep_to_the_slope_and_leave_noise():
    rnd = random.Random(4)
    line = [(float(x), rnd.uniform(-8, 8), 2.0, i) for i, x in enumerate(range(0, 400, 20))]
    moved = [(float(x), 900 + rnd.uniform(-8, 8), 2.0, 100 + i) for i, x in enumerate(range(100, 200, 20))]
    noise = [(rnd.uniform(0, 400), off, 2.0, 200 + i) for i, off in enumerate((200.0, 350.0, 500.0, -300.0))]
    got = align.chains(sorted(line + moved + noise), 1.0, 100.0, [20.0, 40.0])
    assert sorted(sorted(p[3] for p in c) for c in got) == [list(range(20)), list(range(100, 105))]
    backwards = sorted((float(x), -2.0 * x, 1.2, x) for x in range(0, 400, 20))
    assert align.chains(backwards, 1.0, 100.0, [20.0, 40.0]) == []
    assert not align._keeps_slope(backwards, 1.0, 60.0) and align._keeps_slope(line, 1.0, 20.0)


def test_a_list_of_the_same_words_backwards_is_no_translation(monkeypatch):
    low = "anvil birch cedar drum ember flint grove heron inlet jetty".split()
    lexicon = bitext.Lexicon({w: {f"{w[:2]} {w[2:]}": 1.0} for w in low}, dict.fromkeys(low, 2.0))
    fill = " and many others of that town "
    rest = " ".join(f"Kasper {k}." for k in range(100, 120))
    o, t = f"{fill.join(low)}. {rest}", f"{fill.join(f'{w[:2]} {w[2:]}' for w in low)}. {rest}"
    assert (0, 0) in align.align(o, t, lexicon)
    back = f"{fill.join(f'{w[:2]} {w[2:]}' for w in low[::-1])}. {rest}"
    assert (0, 0) not in align.align(o, back, lexicon)
    monkeypatch.setattr(align, "RESIDUALS", (1e9,))
    monkeypatch.setattr(align, "STRAY", 1e9)
    assert (0, 0) in align.align(o, back, lexicon)


def test_a_moved_sentence_keeps_its_points_for_often_repeated_names():
    n = 100  # every name is as frequent; the first sentence is the last of the translation
    source = ["Anna Berta Carl."] + [f"Anna Berta Carl {1000 + i} {3000 + i}." for i in range(n)]
    target = source[1:] + source[:1]
    assert (0, n) in align.align(" ".join(source), " ".join(target), bitext.Lexicon())


def test_sentences_end_before_white_space():
    text = "One 3.5 is. Two… Three?! four"
    assert [text[a:b] for a, b in bitext.sentences(text)] == ["One 3.5 is.", "Two…", "Three?!", "four"]


def test_defects(spark, world, docs):
    o = "The lantern is harder to explain than the river."
    refusals = [{"original_text": f"{sentence(random.Random(i))[0]}", "translated_text": "Rất tiếc, tôi không thể dịch đoạn này vào lúc này."} for i in range(4)]
    odd = [
        {"original_text": o, "translated_text": "[[[P_c1]]]"}, {"original_text": o, "translated_text": None}, {"original_text": o, "translated_text": f"Bản dịch: {o.upper()}"},
        {"original_text": "f(x) = 3", "translated_text": "f(x) = 3"}, {"original_text": o, "translated_text": "La lanterne est plus difficile à expliquer que la rivière et le pont."},
        {"original_text": o, "translated_text": "孩子们沿着河岸走了很久。"}, {"original_text": o, "translated_text": "N/A", "tag": "img"}, {"original_text": o, "translated_text": "", "status": "pending"}, {"original_text": None, "translated_text": None},
    ]
    got = {r.row_id: r.defect for r in defects.found(paras(spark, world + refusals + odd), docs).collect()}
    assert got == {400: "refusal", 401: "refusal", 402: "refusal", 403: "refusal", 404: "empty", 405: "empty", 406: "copy", 408: "wrong_language", 409: "wrong_language"}


def test_phrases_of_a_template_show_refusals_with_other_openings(spark, world, docs):
    rnd = random.Random(5)

    def opening(shared):
        fill = ["".join(rnd.choice("bdklmnrst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(9)]
        at = rnd.randint(0, 9)
        return " ".join([*fill[:at], shared, *fill[at:]])

    shared = ["this passage must stay untouched", "không thể dịch đoạn văn", "outside what i may handle", "tôi không dịch đoạn này"]
    alike = [{"original_text": sentence(random.Random(i))[0] + f" {i} {k}", "translated_text": f"dona teka mira {x}."} for i, x in enumerate(shared) for k in range(3)]
    refusals = alike + [{"original_text": sentence(random.Random(i))[0] + f" {i}", "translated_text": opening(x)} for i, x in enumerate(shared * 3)]
    alone = [{"original_text": sentence(random.Random(99))[0], "translated_text": opening("that recurs in two only")} for _ in range(2)]
    known = docs.unionByName(spark.createDataFrame([("en", r["translated_text"]) for r in refusals + alone], docs.schema))
    got = {r.row_id: r.defect for r in defects.found(paras(spark, world + refusals + alone), known).collect()}
    assert {k: got.get(k) for k in range(400, 424)} == dict.fromkeys(range(400, 424), "refusal")
    assert "refusal" not in {got.get(424), got.get(425)}


def test_openings_are_grouped_as_by_brute_force(spark):
    rnd = random.Random(8)
    heads = sorted({" ".join(rnd.choice("ab") for _ in range(rnd.randint(5, 9))) for _ in range(120)})
    cut = {h: frozenset(" ".join(h.split()[i : i + 5]) for i in range(len(h.split()) - 4)) for h in heads}
    links = defects._linked(spark.createDataFrame([(h, list(s)) for h, s in cut.items()], "opening string, shingles array<string>"))
    for r in links.collect():
        assert len(cut[r.a] & cut[r.b]) >= 0.8 * len(cut[r.a] | cut[r.b])
    got = {r.opening: r.group for r in defects._groups(links).collect()}
    parent = {h: h for h in heads}

    def root(h):
        while parent[h] != h:
            h = parent[h]
        return h

    for a in heads:
        for b in heads:
            if len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert got == {h: root(h) for h in heads}


def test_long_openings_are_grouped_as_by_brute_force(spark):
    rnd = random.Random(4)
    stems = [[f"{x}{i}" for i in range(20)] for x in "abcdef"]
    words = [[rnd.choice(["u", "v", w, w, w]) if rnd.random() < 0.5 else w for w in rnd.choice(stems)[rnd.randint(0, 4) : rnd.randint(10, 20)]] for _ in range(150)]
    cut = {" ".join(w): frozenset(" ".join(p) for p in zip(w, w[1:])) for w in words}
    links = defects._linked(spark.createDataFrame([(h, list(s)) for h, s in cut.items()], "opening string, shingles array<string>"), defects.ALIKE)
    near = {(a, b) for a in cut for b in cut if len(cut[a] & cut[b]) >= len(cut[a] | cut[b]) / 3}
    assert {(r.a, r.b) for r in links.collect()} <= near
    group = {h: h for h in cut}
    while moved := [(a, b) for a, b in near if group[b] < group[a]]:
        for a, b in moved:
            group[a] = min(group[a], group[b])
    assert {r.opening: r.group for r in defects._groups(links).collect()} == group
    assert 6 <= len(set(group.values())) < len(group) / 2


def test_openings_of_a_template_may_begin_and_end_differently(spark, world, docs):
    shared = "no translation can be given for this section as it stands"
    begun = ["Regrettably", "Dear reader of mine", "As an automated translator", "Thank you for the text"]
    ended = ["without more context.", "because of my guidelines.", "at this time.", "today."]
    alike = [{"original_text": sentence(random.Random(i))[0] + f" {i}", "translated_text": f"{b} {shared} {e}"} for i, (b, e) in enumerate(zip(begun, ended))]
    rnd = random.Random(6)
    fill = [["".join(rnd.choice("bdklmnrst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(15)] for _ in range(4)]
    apart = [{"original_text": sentence(random.Random(i))[0] + f" {i}", "translated_text": " ".join([*f[:7], "that night the harbor slept", *f[7:]]) + "."} for i, f in enumerate(fill, 50)]
    known = docs.unionByName(spark.createDataFrame([("en", r["translated_text"]) for r in alike + apart], docs.schema))
    got = {r.row_id: r.defect for r in defects.found(paras(spark, world + alike + apart), known).collect()}
    assert [got.get(k) for k in range(400, 404)] == ["refusal"] * 4
    assert "refusal" not in {got.get(k) for k in range(404, 408)}


def test_languages_without_documents_are_told_from_the_target(spark, docs):
    p = language.learn(docs)
    assert p.languages([language.spoken(bitext.WORD.findall(x)) for x in ("Chiếc đèn lồng khó giải thích hơn dòng sông.", "Nobody believed in the letter.", "Nikt nie wiedział, dlaczego latarnia zgasła.", "孩子们沿着河岸走了很久。", "Anna 12", "")])[:2] == ["vi", "en"]
    odd = ["Nikt nie wiedział, dlaczego latarnia zgasła w nocy.", "Nessuno sapeva perché il faro si fosse spento nella notte.", "1872年的记录没有提到这封信。", "E = mc 2", ""]
    got = p.languages([language.spoken(bitext.WORD.findall(x)) for x in odd])
    assert all(x not in ("vi", "") for x in got[:3]) and got[4] == ""
    assert language.learn(docs.limit(0)).languages(["một hai ba bốn", ""]) == ["other", ""]


def test_replies_mostly_in_another_language(spark, world, docs):
    o = "Anna explained the lantern. Nobody believed in the compiler near the harbor. A message explained the old bridge."
    odd = [
        "Nobody in the town knew why it had more of it. There was not a single word for that. Chiếc đèn lồng khó giải thích hơn dòng sông.",
        "Anna nie wiedziała, dlaczego latarnia zgasła w nocy, a most był zamknięty.", "Anna non sapeva perché il faro si fosse spento nella notte del mercato.",
        "Anna giải thích về chiếc đèn lồng. Không ai tin vào trình biên dịch gần bến cảng. Einer war da.",
    ]
    got = {r.row_id: r.defect for r in defects.found(paras(spark, world + [{"original_text": o, "translated_text": t} for t in odd]), docs).collect()}
    assert [got.get(400 + i) for i in range(1, 4)] == ["wrong_language", "wrong_language", None]


def test_refusals_that_name_their_original_and_copies_with_many_marks_are_found(spark, world, docs):
    o = "Anna: the lantern is harder to explain than the river. Nobody believed in the compiler near the harbor. A message explained the old bridge and the letter."
    refusals = [{"original_text": f"{o} {'x' * i}", "translated_text": "Rất tiếc, tôi không thể dịch đoạn văn nói về Anna vào lúc này."} for i in range(3)]
    cut = {"original_text": o, "translated_text": "Rất tiếc, tôi không thể dịch đoạn văn nói về Anna"}
    marked = "The lantern of ấầẩẫậ ấầẩẫậ is harder to explain than the river."
    mixed = "It was the lantern that the river had, and there was more of it. Ấầẩẫậ ấầẩẫậ."
    odd = [cut, {"original_text": marked, "translated_text": marked.upper()}, {"original_text": o, "translated_text": f"{mixed} Chiếc đèn lồng khó giải thích hơn dòng sông."}]
    got = {r.row_id: r.defect for r in defects.found(paras(spark, world + refusals + odd), docs).collect()}
    assert {k: got.get(k) for k in range(400, 406)} == {400: "refusal", 401: "refusal", 402: "refusal", 403: got.get(403), 404: "copy", 405: "wrong_language"}
    assert got.get(403) != "refusal"


# 5 ---------------------------------------------------------------------------------------------


def test_bucket_bounds_are_optimal():
    rnd = random.Random(2)
    for _ in range(20):
        hist = {s: rnd.randint(1, 5) for s in rnd.sample(range(1, 30), 8)}
        sizes = sorted(hist)

        def pad(bounds):
            return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in hist.items())

        from itertools import combinations

        best = min(pad([*c, sizes[-1]]) for c in combinations(sizes[:-1], 2))
        assert pad(containers.bucket_bounds(hist, 3)) == best
    assert containers.bucket_bounds({}, 3) == []


def test_containers_hold_everything_once_and_waste_little(spark):
    rnd = random.Random(4)
    rows = [(i, "g" if i % 3 else "h", rnd.choice([0, 1, 5, 30, 60, 99, 100, 250])) for i in range(900)] + [(7, "g", None), (7, "g", 5)]
    df = spark.createDataFrame(rows, "id int, block_key string, n int").withColumn("n", F.coalesce("n", F.lit(0)))
    got = containers.fill(df, ["block_key"], "id", "n", 100, block=200).collect()
    load = {}
    for r in got:
        load[r.block_key, r.block, r.batch_no] = load.get((r.block_key, r.block, r.batch_no), 0) + r.size
    assert max(load.values()) <= 100
    assert sum(r.size for r in got) == sum(r[2] or 0 for r in rows)
    assert sum(1 for r in got if r.part_no == 0) == len(rows)
    assert sum(load.values()) / (100 * len(load)) > 0.9
    assert containers.fill(df.limit(0), ["block_key"], "id", "n", 100).count() == 0


# 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,want,kinds", [
    ("ＯＦ 4４", "OF 44", ["full_width"]), ("ề đi", "ề đi", ["combining"]), ("ke​o", "keo", ["zero_width"]), ("a b c", "a b c", ["no_break_space"]),
    ("Wynjοsa", "Wynjosa", ["look_alike"]), ("trὸ chuyện", "trò chuyện", ["look_alike"]), ("«дождь» λ = 2 Ω, kΩ", "«дождь» λ = 2 Ω, kΩ", []), ("plain ấ", "plain ấ", []), ("", "", []),
])
def test_canonical_forms(text, want, kinds):
    assert normalize.canonical(text) == (want, kinds)
    assert normalize.canonical(want)[0] == want and unicodedata.is_normalized("NFC", want)


def test_stable_values_stay_in_the_jvm_and_all_come_out(spark):
    df = spark.createDataFrame([(1, "a​", None), (1, "b", "c"), (2, None, "ｘ")], "row_id long, value string, field_name string")
    got = sorted((r.record_id, r.field_name, r.changed, r.canonical) for r in normalize.normalize_values(df, "k", "row_id", ["value", "field_name"]).collect() if r.canonical)
    assert got == [(1, "field_name", False, "c"), (1, "value", False, "b"), (1, "value", True, "a"), (2, "field_name", True, "x")]
    assert normalize.disguised_values(df, "k", "row_id", ["value", "field_name"]).count() == 2


# 7 ---------------------------------------------------------------------------------------------

KNOWN = scans.Words({w: 100 for w in "the court was larger than a half-open gate of trial burden proof winter came they walked to school every one everyone page open".split()})


@pytest.mark.parametrize("text,want,kinds", [
    ("the coiirt was lar-\nger than", "the court was larger than", {"ocr_char", "hyphen"}), ("a half-\nopen gate", "a half-open gate", set()), ("the tri¬\nal came", "the trial came", {"hyphen"}),
    ("bur- den of proof", "burden of proof", {"hyphen"}), ("thecourt was", "the court was", set()), ("Rudor came", "Rudor came", set()), ("the 7rial", "the Trial", {"ocr_char"}),
])
def test_decoding(text, want, kinds):
    assert scans.decode(text, KNOWN) == (want, kinds)


def test_hyphen_at_the_end_of_a_page():
    assert scans.decode("they came every-", KNOWN, "one")[1] == {"hyphen"}
    assert scans.decode("they came half-", KNOWN, "open")[1] == set()
    assert scans.decode("came larger", KNOWN, "", "win")[1] == set()


def test_pages_lose_headers_and_numbers_but_not_tables():
    keys = scans.title_keys(["The Tria1 ..... 12", "Chapter 3: The Court"])
    assert scans.page_parts("THE TRIAL\n[26]\nthey walked", keys, None, 1) == (["THE TRIAL"], ["they walked"], True)
    assert scans.page_parts("26   Chapter 3: The Court\nthey walked", keys, None, 1) == (["26   Chapter 3: The Court"], ["they walked"], True)
    assert scans.page_parts("they walked\n179\n205\n887", keys, None, 1) == ([], ["they walked", "179", "205", "887"], False)
    assert scans.page_parts("they walked\n12", keys, 11, 1) == ([], ["they walked"], True)
    assert scans.page_parts("The court\nthey walked", keys, None, 1)[0] == []
    assert scans.repair_page(None, keys, KNOWN) == ([], False, [])
    assert scans.repair_title("The Cour- t\t31", scans.Words({"the": 9, "court": 9}))[1] == ["hyphen", "page_number"]


def test_headers_without_a_title_repeat_at_the_top(spark):
    body = "they walked to school.\neveryone came"
    pages = [{"original_text": f"The Empty Page   {20 + i}\n{body}"} for i in range(4)] + [{"original_text": f"everyone.\n{body}"} for _ in range(4)] + [{"original_text": None}, {"original_text": "the walk- "}]
    pages = [r | {"para_index": i + 1} for i, r in enumerate(pages)]
    books = spark.createDataFrame([("p", "Other", "pdf", "textbook"), ("p", "Other", "pdf", "textbook")], "project_id string, title string, source_format string, document_type string")
    chapters = spark.createDataFrame([(1, "p", "c", None), (2, "p", "c", None)], "chapter_row_id long, project_id string, chapter_id string, title string")
    got = {r.row_id: set(r.kinds) for r in scans.repair_books(paras(spark, pages), chapters, books)[0].collect()}
    assert all(got[i] == {"header", "page_number"} for i in range(4)) and all(got[i] == set() for i in range(4, 9))
    assert scans.found(paras(spark, pages).limit(0), chapters.limit(0), books.limit(0)).count() == 0


def test_the_next_page_is_read_beyond_blank_lines(spark):
    known = "they came every day and everyone came to a half-open gate of the school one more time"
    texts = ["they came every-", "\n" + " \n" * 200 + "one came.", "they came half-", "\n" + " \n" * 200 + "open the school."]
    rows = [{"original_text": t, "para_index": i + 1} for i, t in enumerate(texts)] + [{"project_id": "q", "original_text": known, "para_index": i} for i in range(50)]
    books = spark.createDataFrame([("p", "Other", "pdf", "textbook"), ("q", "Words", "txt", "novel")], "project_id string, title string, source_format string, document_type string")
    chapters = spark.createDataFrame([(1, "p", "c", None)], "chapter_row_id long, project_id string, chapter_id string, title string")
    got = {r.row_id: set(r.kinds) for r in scans.repair_books(paras(spark, rows), chapters, books)[0].collect()}
    assert (got[0], got[2]) == ({"hyphen"}, set())


# 8 ---------------------------------------------------------------------------------------------


@needs_tokenizer
def test_ids_decode_to_the_text(spark):
    texts = ["", None, "Hello  world\r\n\t<|endoftext|> 日本語 🙂 don't", " ", "a" * 3000, "x y " * 40_000, "  b  " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in encode.encode(df).collect()}
    assert got[0] == [] and got[1] == []
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    enc = encode._encoding(encode.DEFAULT_RANKS)
    assert all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts) if t)


def test_safe_pieces_join_to_the_text():
    text = words_text(30_000, 9)
    parts = encode.safe_pieces(text, 1000)
    assert "".join(parts) == text and len(parts) > 20
    assert encode.safe_pieces("z" * 5000, 1000) == ["z" * 5000]


# 9 ---------------------------------------------------------------------------------------------


def test_quotas_split_exactly():
    q = np.array([17, 0, 5])
    parts = mixing.split_quotas(q, 6, np.random.default_rng(1))
    assert len(parts) == 6 and (sum(parts) == q).all() and max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 2


@needs_tokenizer
def test_mix_meets_shares_and_caps(spark):
    rnd = random.Random(5)
    docs = [(i, words_text(rnd.randint(20, 60), i), rnd.choice(["a", "a", "a", " A ", "b", "c"])) for i in range(1500)] + [(9001, None, "a"), (9002, "", "b"), (9003, "x", None), (9004, "x", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.3, 1), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    rows, report = mixing.mix(df, targets, blocks=64)
    rep = {r.source: r for r in report.collect()}
    assert rep["a"].reached and abs(rep["a"].mix_tokens / rep["a"].planned_tokens - 1) < 0.02
    assert not rep["c"].reached and rep["c"].mix_tokens == rep["c"].source_tokens
    got = rows.collect()
    assert len({(r.doc_id, r.repeat_no) for r in got}) == len(got) and not {9001, 9003, 9004} & {r.doc_id for r in got}
    assert [(r.shard, r.doc_id) for r in got] and sorted(map(tuple, mixing.mix(df, targets, blocks=64)[0].collect())) == sorted(map(tuple, got))
    assert mixing.mix(df.limit(0), targets, blocks=8)[0].count() == 0


# 10 --------------------------------------------------------------------------------------------


def test_subjects_on_held_out_documents(spark):
    rnd = random.Random(6)
    terms = {"law": ["court", "statute", "verdict", "appeal"], "sport": ["goalkeeper", "stadium", "marathon", "referee"], "cookery": ["broth", "dough", "recipe", "saucepan"]}
    plain = ["river", "lantern", "bridge", "letter", "storm", "island"]
    docs, truth = [], {}
    for i in range(900):
        own = rnd.sample(sorted(terms), rnd.choice([0, 1, 1, 1, 2]))
        sents = [f"The {rnd.choice(terms[rnd.choice(own)]) if own and rnd.random() < 0.7 else rnd.choice(plain)} was larger than the {rnd.choice(plain)} on that day." for _ in range(rnd.randint(8, 14))]
        docs.append((i, " ".join(sents), rnd.choice(["en", "EN ", None])))
        truth[i] = set(own)
    docs += [(9001, None, None), (9002, "  ", "en")]
    labels = [(i, s) for i in range(0, 900, 5) for s in truth[i]] + [(0, "law"), (77777, "law"), (5, "unknown")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = subjects.found(df, spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in terms], "subject string")).collect()
    found = {(r.doc_id, r.subject) for r in got if r.doc_id % 5}
    want = {(i, s) for i, ss in truth.items() if i % 5 for s in ss}
    assert len(found & want) / len(found | want) > 0.9
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.found(df, none, spark.createDataFrame([(s,) for s in terms], "subject string")).count() == 0


def test_paragraphs_go_on_over_pages(spark):
    schema = "row_id long, project_id string, chapter_id string, para_index int, paragraphs array<string>, runs_on boolean, kinds array<string>"
    rows = [
        (1, "p", "c", 0, ["One.", "It be-"], True, ["hyphen"]), (2, "p", "c", 1, ["gan in the"], True, []), (3, "p", "c", 2, ["very well-"], True, []), (4, "p", "c", 3, ["known town.", "Two."], False, []),
        (5, "p", "c", 4, ["Three"], True, []), (6, "p", "c", 4, ["Three again"], True, []), (7, "p", "c", 9, ["Alone"], True, []), (8, "q", "c", 5, ["Other."], False, []), (9, None, "c", 5, ["x"], True, []), (10, "p", "c", 20, [], True, []),
    ]
    got = {(r.project_id, r.row_id, r.place): (r.n_pages, r.text) for r in scans.continuous(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("p", 1, 0): (1, "One."), ("p", 1, 1): (4, "It began in the very well-known town."), ("p", 4, 1): (1, "Two."), ("p", 5, 0): (1, "Three"), ("p", 7, 0): (1, "Alone"), ("q", 8, 0): (1, "Other."),
    }
    assert scans.continuous(spark.createDataFrame([], schema)).count() == 0


def test_forms_by_properties():
    assert normalize.canonical("e\u1dc4!") == ("e\u1dc4!", ["combining"])
    assert normalize.canonical("\u1112\u1161\u11ab") == ("한", ["other_form"])
    assert normalize.canonical("Stop！ ﬁne \u212b") == ("Stop! fine Å", ["other_form"])
    assert normalize.canonical("👩\u200d🚀 क\u094d\u200dष") == ("👩\u200d🚀 क\u094d\u200dष", [])
    assert normalize.canonical("a\u200db") == ("ab", ["zero_width"])
    quick = __import__("re").compile(normalize.QUICK_CHECK)
    for p in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:  # a value that the quick check passes is in its canonical form
        c = f"x{chr(p)}x"
        assert quick.search(c) or normalize.canonical(c)[0] == c, hex(p)
