"""Personal data, quality, licenses, repeated units."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import DOCS, base_spans, by_id, documents, quality_figures

from marginalia.llm import licenses, linededup, pii, quality


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ODD = [
    None, "", "a@b.c", "x.y@@a.b a@b..c a@b.c.d-e_f", "é😀 a@b.cd 1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1.1", "0001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 22",
    "+1 (555) 123-4567 +49.30.1234567 +123", "+1234567890123456", "++12345678901", "a" * 5000 + "@b.c", "@" * 50, "1" * 3000, "1." * 3000, "+1 " * 2000, "a@b.c" * 100, "a@b.c@d.e a.b@c-.d", "1.2.3.4@5.6.7.8",
]


def held_to_base(spark, texts):
    got = by_id(pii.report(documents(spark, texts)))
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == sha(want), (t or "")[:80]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [len(re.findall(f"{k}:", want)) for k in ("email", "ip", "card", "phone")]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(filter(None, want.split(","))) <= set(spans)
        starts = [int(x.split(":")[1]) for x in spans]
        assert starts == sorted(starts)


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(2)
    held_to_base(spark, ODD + ["".join(rng.choice("ab1234567890.-@+ ()é%_") for _ in range(rng.randrange(200))) for _ in range(400)])


def test_base_spans_of_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = by_id(pii.report(docs))
    assert all(got[r["doc_id"]]["base_sha256"] == sha(base_spans(r["text"])) for r in docs.collect())


def test_generators_beyond_the_base(spark):
    texts = ["call (555) 123-4567 today", "order 555 123 4567 shipped", "ssn 123-45-6789 on file", 'token = "9f3ab27cd81e4455aa01"', "key: value", "mail jo42 (at) mail7 (dot) org", "iban DE12 3456 7890 1234 5678 90"]
    kinds = [[x.split(":")[0] for x in (r["spans"].split(",") if r["spans"] else [])] for _, r in sorted(by_id(pii.report(documents(spark, texts))).items())]
    assert kinds == [["bare_phone"], [], ["national_id"], ["secret"], [], ["spelled_email"], ["account"]]


def test_secrets_go_whole(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1000))
    parts = ".".join((long[:40], long[40:700], long[700:]))
    texts = [f'token = "{long}" end', f"token = {parts} end", f"secret = {long[:42]}== end", f"api_key: {long[:30]}={long[30:60]} end"]
    got = by_id(pii.redact(documents(spark, texts)))
    assert [got[i]["text"] for i in range(4)] == ["[SECRET] end"] * 4
    spans = by_id(pii.report(documents(spark, texts)))
    assert [spans[i]["spans"] for i in range(4)] == [f"secret:0:{len(t) - 4}" for t in texts]


def test_trees_on_lines_not_fitted(spark):
    """Held out: lines beyond those of the fit, by generator. The trees take what is labelled 1 and leave what is labelled 0."""
    trees, limits = pii.fit(spark)
    assert len(trees) == pii.TREES and all(np.isfinite(x) for x in limits.values())
    lines = pii.labelled_lines(spark, pii.FIT_ROWS, 2000)
    found = lines.join(pii.report(lines.selectExpr("id as doc_id", "text")).selectExpr("doc_id as id", "spans"), "id").collect()
    for kind in pii.EXTRA:
        own = [(r["label"], kind + ":" in r["spans"]) for r in found if r["kind"] == kind]
        taken = [y for y, hit in own if hit]
        assert sum(taken) >= 0.95 * len(taken) and sum(taken) >= 0.9 * sum(y for y, _ in own), kind


def plainly_redacted(text, spans):
    """Spans (start, kind, end) in order, each replaced by its kind, one that begins within another from that one's end."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end > at:
            out += [text[at : max(at, start)], f"[{pii.KINDS[kind].upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def test_many_spans_in_one_text(spark):
    """More than a block of each kind, overlapping ones among them; offsets, selection and redaction against plain loops."""
    rng = random.Random(5)
    kinds = ["mail a{}@b.cd é", "token = abc{}def999xyz1", "+1 (555) 123-{:04}", "write jo{} (at) mail7 (dot) org", "1.2.3.{}", "ssn 123-45-{:04}", "token = a{}@b.cd", "iban DE12 3456 7890 1234 5678 90 {}", "call 555-123-{:04} 😀", "words only {}"]
    texts = [" ".join(rng.choice(kinds).format(rng.randrange(200)) for _ in range(n)) for n in (1, 3, 50, 700, 1500)]
    held_to_base(spark, texts)
    report, redacted = by_id(pii.report(documents(spark, texts))), by_id(pii.redact(documents(spark, texts)))
    for i, text in enumerate(texts):
        spans = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in report[i]["spans"].split(",") if x)]
        assert spans == sorted(spans) and report[i]["n_spans"] == len(spans)
        base = [x for x in spans if x[1] < len(pii.BASE)]
        extra = [x for x in spans if x[1] >= len(pii.BASE)]
        assert not any(a < d and c < b for a, _, b in extra for c, _, d in base)
        assert all(x[2] <= y[0] for x, y in zip(extra, extra[1:]))
        assert redacted[i]["text"] == plainly_redacted(text, spans)


def test_personal_data_of_odd_rows(spark):
    schema = "doc_id long, text string, base string, spans string, _more int, n_chars int"
    rows = [(1, "a@b.cd", "x", "y", 1, 6), (1, "a@b.cd", "x", "y", 1, 6), (None, None, None, None, None, None), (2, "", "", "", 0, 0), (3, "a" * 300_000 + " a@b.cd", "", "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or 0, r["n_email"], r["spans"], r["n_spans"]) for r in pii.report(docs).collect())
    assert got == [(0, 0, "", 0), (1, 1, "email:0:6", 1), (1, 1, "email:0:6", 1), (2, 0, "", 0), (3, 1, "email:300001:300007", 1)]
    back = pii.redact(docs)
    assert back.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[-8:], r["spans"] or "") for r in back.collect()) == [(0, "", ""), (1, "[EMAIL]", "y"), (1, "[EMAIL]", "y"), (2, "", ""), (3, " [EMAIL]", "")]
    assert pii.report(spark.createDataFrame([], schema)).isEmpty()


def test_redaction(spark):
    texts = ["write a@b.cd now, or 1.2.3.4", "nothing", None, "a@b.cd"]
    docs = documents(spark, texts).withColumnRenamed("lang", "spans")
    got = by_id(pii.redact(docs))
    assert [got[i]["text"] for i in range(4)] == ["write [EMAIL] now, or [IP]", "nothing", None, "[EMAIL]"]
    assert [got[i]["n_chars"] for i in range(4)] == [len("write [EMAIL] now, or [IP]"), 7, None, 7] and got[0]["spans"] == "en"
    assert pii.redact(spark.createDataFrame([], DOCS)).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab #*$.é \n\t\x0b "), max_size=200))
def test_quality_figures(text):
    assert quality.clean(text)[0][:5] == quality_figures(text)


def test_quality_of_a_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, labels = by_id(quality.quality(docs)), by_id(spark.read.parquet(f"{sf}/labels.parquet"))
    for r in docs.collect():
        own = got[r["doc_id"]]
        want = quality_figures(r["text"])
        assert (own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"], own["n_repeat_words"]) == want
        assert own["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (own["base_failed"] and own["kept"])
    good = [got[i] for i, x in labels.items() if x["quality"] == 1 and not got[i]["base_failed"]]
    poor = [got[i] for i, x in labels.items() if x["quality"] == 0]
    assert np.mean([x["kept"] for x in good]) > 0.98 and np.mean([x["kept"] for x in poor]) < 0.1


def test_failing_lines_go_and_documents_that_lose_too_much(spark):
    rng = random.Random(1)
    lines = [" ".join(f"word{rng.randrange(400)}" for _ in range(14)).capitalize() + "." for _ in range(6)]
    text = "\n".join(lines)
    texts = [text, text + "\nHome | About | Contact\nALL CAPITALS IN THIS LINE\n" + lines[1], "\n".join(["menu item"] * 60), None, "", text + "\n" + "\n".join(f"link {i}" for i in range(200))]
    got = by_id(quality.keep_good(documents(spark, texts)))
    assert sorted(got) == [0, 1] and got[0]["text"] == text == got[1]["text"] and got[1]["n_chars"] == len(text)
    assert quality.quality(spark.createDataFrame([], DOCS)).isEmpty()


def test_a_phrase_in_a_long_line_is_no_boilerplate():
    prose = " ".join(f"word{i}" for i in range(60)) + ", as their privacy policy says. " + " ".join(f"more{i}" for i in range(40)) + "."
    figures, text = quality.clean(prose)
    assert text == prose and figures[5] == 0 and figures[-1]
    for line in ("Read our privacy policy and the rest of it.", "Click here. Share this. " * 12):
        assert quality.judge_line(line.encode(), len(line.split()), 8) == "boilerplate"


def test_licenses_exact_changed_and_absent(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without any charge").replace("copy, modify", "copy, alter")
    texts = ["Intro words here.\n" + mit + "\nrest", "x " + changed, "this text permits nothing of the kind at all", None, "", "Released under the MIT License. More. All rights reserved."]
    found = licenses.scan(documents(spark, texts)).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["license"]) for r in found] == [(0, "MIT"), (1, "MIT"), (5, "MIT-line"), (5, "All-rights-reserved")]
    assert found[0]["coverage"] == 1.0 and texts[0][found[0]["start"] : found[0]["end"]] == mit.rstrip(".") and 0.9 < found[1]["coverage"] < 1
    assert licenses.scan(spark.createDataFrame([], DOCS)).isEmpty()


def test_each_template_finds_itself():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        got = licenses.findings(f"Some words before. {text} And some after.", index, licenses.WordHashes(), 0.75)
        assert [(g[0], g[1]) for g in got] == [(name, 1.0)]


def test_kindred_licenses_are_told_apart():
    index = licenses.Index(licenses.TEMPLATES)
    look = lambda t: [(g[0], t[g[3] : g[4]]) for g in licenses.findings(t, index, licenses.WordHashes(), 0.75)]
    assert look("\u0130\u0130 x y. Released under the MIT License. tail") == [("MIT-line", "Released under the MIT License")]
    assert look("so it is licensed under CC BY-NC-ND 4.0, says the author") == [("CC-BY-NC-ND-4.0-short", "licensed under CC BY-NC-ND 4.0")]
    assert look("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0-line"
    assert look("This work is licensed under the GNU General Public License, version 1.") == []
    lesser = licenses.TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Lesser General")
    assert [n for n, _ in look(lesser)] == ["LGPL-3.0"]


def full_alignment(template, words):
    """(matched, first, end) of the best local alignment without a band: a match 1, a word left out or exchanged -0.5."""
    above, best = [(0.0, 0, j) for j in range(len(words) + 1)], (0.0, 0, 0, 0)
    for want in template:
        row = [(0.0, 0, 0)]
        for j, w in enumerate(words):
            d, u, left = above[j], above[j + 1], row[j]
            cell = (d[0] + 1, d[1] + 1, d[2]) if w == want else max(((x[0] - 0.5, *x[1:]) for x in (d, u, left)), key=lambda x: x[0])
            row.append(cell if cell[0] > 0 else (0.0, 0, j + 1))
            if row[-1][0] > best[0]:
                best = (row[-1][0], row[-1][1], row[-1][2], j + 1)
        above = row
    return best[1:]


def test_licenses_of_a_whole_table_as_full_alignment_has_them(spark, sf):
    """Every document and template that can match by the words it holds is aligned in full; what reaches the limit is found, or a better match in its place."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    index = licenses.Index(licenses.TEMPLATES)
    n = 0
    for r in docs.collect():
        tokens = list(licenses.TOKEN.finditer(r["text"] or ""))
        words = [m[0].lower() for m in tokens]
        held = set(words)
        for name, template in index.words.items():
            if sum(w in held for w in template) < 0.75 * len(template):
                continue
            matched, first, end = full_alignment(template, words)
            if matched < 0.75 * len(template) or licenses.telling(template) != licenses.telling(words[first:end], len(template)):
                continue
            n += 1
            start, stop = tokens[first].start(), tokens[end - 1].end()
            assert any(f["start"] < stop and start < f["end"] and f["matched_words"] >= matched for f in found.get(r["doc_id"], [])), (r["doc_id"], name)
    assert n >= 3 and sum(map(len, found.values())) >= 3


def test_licenses_of_odd_rows(spark):
    schema = "doc_id long, text string, license string, start int, coverage string"
    line = "Released under the MIT License."
    rows = [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, "word " * 100_000 + line)]
    got = sorted(((r["doc_id"] or 0, r["license"], r["start"]) for r in licenses.scan(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)).collect()))
    assert got == [(0, "MIT-line", 0), (1, "MIT-line", 0), (1, "MIT-line", 0), (4, "MIT-line", 500_000)]
    assert licenses.scan(spark.createDataFrame([], schema)).isEmpty()


def test_quality_of_odd_rows(spark):
    good = " ".join(f"Word{i} goes{i} on and on{i} here, as{i} it should{i}." for i in range(20))
    schema = "doc_id long, text string, kept string, n_words int, clean_text string"
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in [(1, good), (1, good), (None, good), (2, None), (3, ""), (4, "a " * 100_000)]], schema)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality.quality(docs, with_text=True).collect())
    assert got == [(0, 180, True), (1, 180, True), (1, 180, True), (2, 0, False), (3, 0, False), (4, 100_000, False)]
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in quality.keep_good(docs).collect()) == [(0, "x"), (1, "x"), (1, "x")]
    assert quality.quality(spark.createDataFrame([], schema)).isEmpty() and quality.keep_good(spark.createDataFrame([], schema)).isEmpty()


def test_repeats_go_and_offsets_stay(spark):
    passage = "This passage of rather many words stands in several documents. It goes on for another sentence with some more words, and ends."
    texts = {5: f"Own text one of five. {passage} Tail.", 2: f"{passage}\nOther own text with a few more words in it than eight.", 9: passage, 11: "short\nshort\nshort", 12: None, 13: ""}
    got = by_id(linededup.remove_repeats(documents(spark, texts), unit="sentence", min_words=8, inner=None))
    assert got[2]["text"] == texts[2] and got[5]["text"] == "Own text one of five. Tail." and got[9]["text"] == "" and got[11]["text"] == texts[11] and got[12]["text"] is None
    for i in (5, 9):
        assert all(texts[i][s["start"] : s["end"]] in passage for s in got[i]["removed"]) and got[i]["n_removed"] == 2
        assert got[i]["chars_removed"] == sum(s["end"] - s["start"] for s in got[i]["removed"])
    assert linededup.remove_repeats(spark.createDataFrame([], DOCS)).isEmpty()


def plain_units(text, sentences):
    """(start, end, words) of lines, or of the sentences in lines: a sentence ends after . ! or ? before white space."""
    out, at = [], 0
    for k, c in enumerate(text + "\n"):
        ends = c == "\n"
        if sentences and not ends and c in ".!?" and (k + 1 == len(text) or text[k + 1] in " \t\n"):
            ends, k = True, k + 1
        if ends:
            piece = text[at:k]
            words = piece.lower().strip(linededup.EDGES).split()
            if words:
                out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip()), tuple(words)))
            at = k if sentences and c != "\n" else k + 1
    return out


def plain_chains(text, sentences, least):
    """(start, end, words of each) of every unit with as many before it as it takes to have that many words."""
    out, own = [], plain_units(text, sentences)
    for k in range(len(own)):
        j = k
        while j >= 0 and sum(len(w) for _, _, w in own[j : k + 1]) < least:
            j -= 1
        if j >= 0:
            out.append((own[j][0], own[k][1], tuple(w for _, _, w in own[j : k + 1])))
    return out


def placed_chains(texts):
    """(kind, words) -> its places (doc, start, end) in order, over all documents."""
    places = {}
    for doc in sorted(texts):
        for sentences, least in ((False, 15), (True, 25)):
            for start, end, words in plain_chains(texts[doc] or "", sentences, least):
                places.setdefault((sentences, words), set()).add((doc, start, end))
    return {k: sorted(v) for k, v in places.items()}


def test_repeats_of_a_whole_table_as_brute_force_has_them(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone, stay = {i: set() for i in texts}, {i: set() for i in texts}
    for own in placed_chains(texts).values():
        for k, (doc, start, end) in enumerate(own):
            if len(own) > 1:
                (gone if k else stay)[doc].update(range(start, end))
    got = by_id(linededup.remove_repeats(docs))
    for i, text in texts.items():
        ink = {k for k in gone[i] - stay[i] if not text[k].isspace()}
        removed = {k for s in got[i]["removed"] for k in range(s["start"], s["end"])}
        assert {k for k in removed if not text[k].isspace()} == ink
        assert got[i]["chars_removed"] == len(removed) and got[i]["n_removed"] == len(got[i]["removed"])


def test_every_repeated_digest_is_left_somewhere(spark):
    """Whatever the rule is: what several places have is found in the result, cut anew."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    repeated = {k for k, own in placed_chains(texts).items() if len(own) > 1}
    left = placed_chains({i: r["text"] for i, r in by_id(linededup.remove_repeats(docs)).items()})
    assert len(repeated) > 1000 and not repeated - set(left)
    again = sum(len(own) > 1 for k, own in left.items() if k in repeated)
    assert again < 0.05 * len(repeated)  # and most stand there once; more where copies share units with chains that are first


def test_what_is_first_stays_where_copies_reach_into_it(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(8)) for x in "abc")
    texts = {0: "\n".join(["la la la"] * 40), 1: f"{b}\n{c}", 2: f"{a}\n{b}\n{c}", 3: f"{a}\n{b}"}
    got = by_id(linededup.remove_repeats(documents(spark, texts), inner=None))
    assert {i: r["text"] for i, r in got.items()} == {0: "\n".join(["la la la"] * 5) + "\n", 1: texts[1], 2: f"{a}\n{b}\n", 3: ""}


def test_spans_without_others():
    rng = random.Random(4)
    for _ in range(300):
        one, other = (linededup.union(sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 5))) for _ in range(2))
        points = lambda spans: {k for a, b in spans for k in range(a, b)}
        left = linededup.without(one, other)
        assert points(left) == points(one) - points(other) and left == sorted(left) and all(a < b for a, b in left)


def test_a_passage_within_a_line_and_common_short_lines(spark):
    passage = " ".join(f"p{i}" + "." * (i % 9 == 8) for i in range(60))
    footer = "all of this was written by the same hand as ever"
    texts = {1: f"One of a kind here. {passage}\n{footer}", 2: f"And again another start {passage} and its end.\n{footer}", 3: f"nothing else\n{footer}"}
    got = by_id(linededup.remove_repeats(documents(spark, texts)))
    assert [got[i]["n_removed"] > 0 for i in (1, 2, 3)] == [False, True, False]
    lines = by_id(linededup.remove_repeats(documents(spark, texts), min_words=5, inner=None))
    assert [lines[i]["n_removed"] for i in (1, 2, 3)] == [0, 1, 1] and lines[3]["text"] == "nothing else\n"


def test_repeats_of_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(20))
    schema = "doc_id long, text string, digest string, first int, spans string, n int"
    rows = [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, f"{line}\n{line}"), (5, "x" * 100_000 + "\n" + line)]
    got = sorted(((r["doc_id"], r["n_removed"], r["chars_removed"], len(r["text"] or "")) for r in linededup.remove_repeats(spark.createDataFrame([(*r, "d", 1, "s", 2) for r in rows], schema)).collect()), key=repr)
    n = len(line)
    assert got == sorted([(1, 0, 0, n), (1, 0, 0, n), (None, 0, 0, n), (2, 0, 0, 0), (3, 0, 0, 0), (4, 2, 2 * n, 0), (5, 1, n, 100_001)], key=repr)
    assert linededup.remove_repeats(spark.createDataFrame([], schema)).isEmpty()


def words_in_earlier_runs(texts, n=50):
    """doc: (start, end) of every word that stands in a run of n words which an earlier document has, by brute force."""
    seen, out = set(), {}
    for doc in sorted(texts):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", texts[doc])]
        runs = [tuple(w for _, _, w in words[i : i + n]) for i in range(len(words) - n + 1)]
        out[doc] = {words[i + k][:2] for i, run in enumerate(runs) if run in seen for k in range(n)}
        seen |= set(runs)
    return out


def test_runs_of_short_units_go_whole(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abdegiklmnorstu") for _ in range(6))
    shouts = " ".join(f"{name()}!!" for _ in range(60))
    verse = "\n".join(f"{name()} {name()} {name()}" for _ in range(25))
    talk = "\n".join(f"{name()}? {name()} {name()}. {name()} {name()} {name()} {name()}!" for _ in range(12))
    own = lambda: " ".join(name() for _ in range(20)).capitalize() + "."
    texts = {1: f"{own()} {shouts}\n{own()}", 2: f"{own()}\n{verse}\n{own()}", 3: f"{own()}\n{talk}", 4: f"{own()} {shouts} {own()}", 5: f"{own()}\n{verse}\n{own()}", 6: f"{own()}\n{talk}\n{own()}", 7: f"{own()}\n{shouts.split()[0]} {own()}"}
    want = words_in_earlier_runs(texts)
    assert {i: len(w) for i, w in want.items()} == {1: 0, 2: 0, 3: 0, 4: 60, 5: 75, 6: 84, 7: 0}
    got = by_id(linededup.remove_repeats(documents(spark, texts)))
    for i, text in texts.items():
        gone = {m.span() for m in re.finditer(r"\S+", text) if any(s["start"] <= m.start() and m.end() <= s["end"] for s in got[i]["removed"])}
        assert gone == want[i]
        assert len(got[i]["text"].split()) == len(text.split()) - len(gone)
        assert got[i]["chars_removed"] == len(text) - len(got[i]["text"]) - (1 if gone else 0)
