"""Evaluation leakage and publishing residue on made cases, and on the small tables."""

import random

import numpy as np
import pytest

from countlake.llm import leakage as lk
from countlake.llm import residue as rs
from countlake.session import table

DOCS = "doc_id long, text string, item_id string, kind int, template string"


# leakage ------------------------------------------------------------------------------------------
def item(rng, k):
    names = [f"{rng.choice(['Wyr', 'Ost', 'Tar', 'Hul', 'Bel'])}{rng.choice(['dra', 'mir', 'gate', 'quo'])}{k}{c}stead" for c in "abcdef"]
    n = [rng.randint(100, 99999) for _ in range(6)]
    return (
        f"The {names[0]} causeway carries {n[0]} firkins in June, yet {names[1]} ledgers showed {n[1]}. "
        f"The third clerk of {names[2]} moved {n[2]} lantern moths past {names[3]} on day {n[3]}, recalling unpaid porters. "
        f"Near {names[4]} the old weather post counted {n[4]} clay tiles and {names[5]} kept {n[5]} of them."
    )


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    items = [(k, ("The sitting is resumed. " if k % 4 == 0 else "") + item(rng, k)) for k in range(30)]
    talk = "The honourable member has never explained the cost of the census. We were given 70 minutes to study 90 pages. The sitting is resumed. Small growers welcome the figures placed in the library. ".split()
    pad = lambda n: " ".join(rng.choice(talk) for _ in range(n))
    docs, want = [], set()

    def add(text, *found):
        docs.append((len(docs) + 1, text, "x", 1, "y"))
        want.update((len(docs), k) for k in found)

    words = lambda k: items[k][1].split()
    add(pad(60) + " " + items[1][1] + " " + pad(50), 1)
    add(items[2][1].upper().replace(",", " ").replace(".", " ; "), 2)
    add("<p>" + " ".join(f"<i>{w}</i>" for w in words(3)).replace("of", "&#111;f") + "</p>", 3)
    add(items[5][1].replace("a", "а").replace("o", "о"), 5)
    w = words(6)
    add(pad(20) + " ".join(w[:14]) + " (Interjection from the left: Resign!) " + " ".join(w[14:]) + pad(9), 6)
    w = [("indeed" if i % 7 == 3 else x) for i, x in enumerate(words(7))]
    add(pad(30) + " " + " ".join(w), 7)
    add(" ".join(words(9)[:16]) + " " + pad(80) + " " + " ".join(words(9)[-16:]), 9)
    add(pad(300) + " " + " ".join(words(10)[10:30]), 10)
    add("­".join(items[11][1][i : i + 5] for i in range(0, len(items[11][1]), 5)), 11)
    add(items[13][1] + " " + items[14][1], 13, 14)
    # not cases: a short quotation, a formula, the same statement about something else, nothing
    add(pad(40) + " " + " ".join(words(15)[:7]) + " " + pad(40))
    add("The sitting is resumed. " * 6)
    add(item(random.Random(99), 77))
    add(pad(400))
    add("")
    add(None)
    add("   \n ")
    docs += [docs[0], (None, items[16][1], "x", 1, "y")]
    return docs, items, want


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, DOCS)
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = lk.leaked_items(d, i, **kw).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id) for r in rows}


def test_leaks(spark, cases):
    docs, items, want = cases
    assert found(spark, docs, items) == want


def test_blocks_of_items_agree(spark, cases):
    docs, items, want = cases
    assert found(spark, docs, [*items, (None, "x"), (500, None), (501, ""), items[3]], block=9) == want


def test_hot_item(spark, cases):
    """A third of all documents holds the same item."""
    docs, items, want = cases
    more = [(1000 + i, "Small growers welcome this. " + items[20][1], "x", 1, "y") for i in range(len(docs) // 2)]
    assert found(spark, docs + more, items) == want | {(r[0], 20) for r in more}


def test_hot_item_without_digits(spark, cases):
    """A leak makes its own words common; a formula of one sentence stays a formula."""
    docs, items, want = cases
    hot = "Herons nested beneath the rusted viaduct while carpenters varnished eleven oaken lecterns for the bishop. Quarrelsome millers bartered saffron against tallow until the abbess locked every granary in Thornwick."
    formula = "Colleagues kindly take your seats so that the chamber may proceed with the ballot on amendments as notified yesterday evening."
    both = [*items, (40, hot), (41, formula + " Glaziers petitioned the duchess about cracked lanterns along the northern causeway near Ember quay.")]
    more = [(1000 + i, "Small growers welcome this. " + hot, "x", 1, "y") for i in range(20)] + [(2000 + i, formula, "x", 1, "y") for i in range(20)]
    assert found(spark, docs + more, both) == want | {(1000 + i, 40) for i in range(20)}


@pytest.mark.parametrize("gap", [50, 400, 5000])
def test_two_far_passages(spark, cases, gap):
    """Ten words and ten words of an item count together, however much is said between; in the wrong order they do not."""
    docs, items, want = cases
    text = "Herons nested beneath rusted viaducts while carpenters varnished eleven lecterns for visiting bishops. Quarrelsome millers bartered saffron against tallow until an abbess locked every granary in Thornwick before harvest."
    w, talk = text.split(), ("small growers welcome the figures placed in the library " * gap).split()[:gap]
    a, b = " ".join(w[:10]), " ".join(w[-10:])
    more = [(1001, f"{a} {' '.join(talk)} {b}", "x", 1, "y"), (1002, f"{b} {' '.join(talk)} {a}", "x", 1, "y"), (1003, f"{' '.join(talk)} {a}", "x", 1, "y")]
    assert found(spark, docs + more, [*items, (40, text)]) == want | {(1001, 40)}


def test_one_answer_is_enough():
    index = lk.ItemIndex.of([(1, " ".join(f"word{chr(97 + i)}" for i in range(15)) + " 1998 tail.")])
    n = len(index.vocab)
    index.settle(np.full(n, 1000), np.zeros(n, np.int64), 1000, {}, 1)
    index.candidates = lambda ids, idf: {0: [0]}
    assert index.leaked("said " * 5 + " ".join(f"word{chr(97 + i)}" for i in range(15)) + " 1998 tail") == [(1, 17)]


def test_no_rows(spark, cases):
    assert found(spark, [], cases[1]) == set() and found(spark, cases[0], []) == set()


def test_long_document(spark, cases):
    _, items, _ = cases
    text = "word " * 60000 + items[4][1] + " other" * 60000 + " " + items[8][1]
    assert found(spark, [(1, text, "x", 1, "y")], items) == {(1, 4), (1, 8)}


def test_svd_spans_the_passages(spark):
    """The randomised factors against NumPy's."""
    rng = np.random.default_rng(0)
    a = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)), 0) + np.outer(rng.random(60), rng.random(40))
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(a)]
    t = spark.createDataFrame(rows, "passage long, words array<int>, weights array<double>").repartition(3)
    p = lk.randomised_svd(t, 40, rank=8)
    best = np.linalg.svd(a)[2][:8]
    got, want = np.linalg.norm(a @ p) ** 2, np.linalg.norm(a @ best.T) ** 2
    assert p.shape == (40, 8) and np.allclose(p.T @ p, np.eye(8), atol=1e-4) and got > 0.98 * want


def test_alignment():
    path = lk.align(np.array([0, 1, 2, 3, 4, 5]), np.array([9, 0, 1, 7, 7, 7, 2, 8, 4, 5]))
    assert [(i, j) for i, j, same in path if same] == [(0, 1), (1, 2), (2, 6), (4, 8), (5, 9)]
    assert lk.align(np.array([0, 1]), np.array([5, 6])) == []


def test_words():
    assert lk.words_of("Café <b>D’Or</b>, 97 614 &amp; 1.234,5 bar-\n ges ар") == ["cafe", "dor", "97614", "1234", "5", "barges", "ap"]


# residue ------------------------------------------------------------------------------------------
CASES = [
    ("The debate on {{ speech.title | default }} was closed.", {"slot"}), ("Reply given on ${date} by Nessa Boux:", {"slot"}), ("We now turn to %VOTE_RESULT%.", {"slot"}), ("Mr/Mrs XX speaker name XX takes the floor.", {"slot"}),
    ("Antwort vom <%= titel %> durch Limell:", {"slot"}), ("La discussion sur [[date de séance]] est close.", {"slot"}), ("[insert party] (@@title@@): I thank the chair.", {"slot"}), ("We now turn to {4}.", {"slot"}), ("The debate on <AGENDA_ITEM> was closed.", {"slot"}), ("Reply given on #PARTY# by __NAME__:", {"slot"}), ("Reply given on %(title)s by x:", {"slot"}),
    ("Long talk about ferries.\nSERVICE UNAVAILABLE (CODE 503). PLEASE TRY AGAIN IN 5 MINUTES.\nMore talk.", {"error"}), ("Erreur 404 : document introuvable.", {"error"}), ("Fehler 403: Zugriff verweigert.", {"error"}), ("java.io.RecordException: cannot open x\n\tat A.get(A.java:12)", {"error"}), ("502 Bad gateway.", {"error"}),
    ("Nessa Boux (Harbour Union): Please enable JavaScript in your browser.", {"script"}), ("Cookies und JavaScript müssen erlaubt sein.", {"script"}), ("Cette page nécessite des scripts, désactivés dans votre navigateur.", {"script"}),
    ("Content coming soon.", {"filler"}), ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", {"filler"}), ("asdf asdf jkl jkl asdf", {"filler"}), ("Text text text text text.", {"filler"}), ("Mustertext zur Ansicht der Gestaltung.", {"filler"}),
    ("The draft still said 'insert name here', and I quote, which tells us how carefully it was read.", set()), ("A citizen told me the form says please enable JavaScript, and her computer is old.", set()), ("When I opened the portal I got a 404, page not found, and that was the reply!", set()),
    ("The minister's answer is like lorem ipsum: a lot of words and no content.", set()), ("An internal server error is not a housing policy.", set()), ("Content coming soon is what the website has promised us for six years.", set()), ("Auf dem Portal steht nur: Seite nicht gefunden, und das nennen Sie Bürgernähe!", set()),
    ("[Interruption] (Laughter) [12] [sic] <p>Less than 5% of 40 million, <1 crown & more.</p>", set()), ("Sur le portail on lit « erreur 404 », voilà votre service public !", set()), ("", set()), ("  \n ", set()), (None, set()), ("......\n------", set()),
]


def kinds(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], DOCS)
    out = {i: set() for i in range(len(texts))}
    for r in rs.residue(df, **kw).collect():
        out[r.doc_id].add(r.kind)
    return out


def test_residue(spark):
    got = kinds(spark, [t for t, _ in CASES])
    assert {CASES[i][0]: k for i, k in got.items()} == {t: k for t, k in CASES}


def test_blank_and_default_slots_of_an_induced_template(spark):
    texts = ["The debate on {{title}} was closed.", "The debate on ${date} was closed.", "The debate on %PARTY% was closed.", "The debate on N/A was closed.", "The debate on  was closed.", "The debate on null was closed.", "The debate on ferries was closed.", "A remark on null results was closed."]
    for kw in ({}, {"patterns": False}):
        got = kinds(spark, texts, **kw)
        assert [got[i] for i in range(8)] == [{"slot"}] * 3 + [{"blank"}] * 3 + [set(), set()]
    # one document alone induces nothing
    assert kinds(spark, texts[2:7])[1] == set()


UNSEEN = ["<<title>>", "{TITLE}", "[TITLE]", "$speaker_name", "~title~", "^party^", "*|PARTY|*", "[~date~]", "#{date}", "XX date of sitting XX", "__PARTY__", "%(date)s", "<DATE>"]


def test_slots_in_unknown_syntax_are_found_by_alignment(spark):
    """No fixed list: the sign around a name does not matter, that its frame varies does."""
    frames = ["We now turn to {}.", "Reply given on {} by Nessa Boux:", "{} (Quiell): I thank the chair.", "Mr/Mrs {} takes the floor."]
    texts = [f.format(x) for x in UNSEEN for f in frames]
    plain = ["[Interruption] We were given 70 minutes.", "We were given 70 minutes.", "(Laughter) We were given 70 minutes.", "[sic] We were given 70 minutes.", "We were given 7 minutes."] * 3
    got = kinds(spark, texts + plain, patterns=False)
    assert all("slot" in got[i] for i in range(len(texts))) and not any("slot" in got[i] for i in range(len(texts), len(got)))


def test_marks_of_stenographers_are_no_slots(spark):
    rng = random.Random(4)
    words = "harbour levy ferry tenants bridge census reserve fund clause parish treaty river night trains schools wells".split()
    talk = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{rng.choice(['[Interruption]', '[sic]', '[Belund: Hear, hear!]', '<p>'])} The {talk(6)} and {talk(5)}. We {talk(9)} {rng.choice(['[sic]', '[12]', '<i>so</i>'])} {talk(4)}." for _ in range(300)]
    assert not any(kinds(spark, texts, patterns=False).values())


def test_unseen_pages_are_found_by_recurrence(spark):
    """Messages no list knows recur as whole pages; formulas recur in speeches, reissued speeches use their words."""
    speech = "The minister welcomes the levy on warehouses and the second reading of the bridge bill before the budget is laid."
    pages = ["Connection timed out after {} seconds.", "Diese Seite existiert nicht mehr.", "Upstream refused handshake, ticket {}.", "Le serveur distant ferme la connexion."]
    texts = [p.format(10 + i) for p in pages for i in range(4)] + [f"{speech}\n{pages[0].format(5)}"]
    formula = ["The sitting is resumed."] * 5 + [f"The sitting is resumed. {speech} Clause {w} was read." for w in "abcdefghij"] + [f"Anna Belund (Old Union):\n{speech}"] * 4
    others = [f"The levy on {a} and the bridge bill {b} the budget is laid, the minister welcomes the second reading of warehouses before {a}." for a in ("ferries", "wells", "trains") for b in ("before", "on", "and")]
    got = kinds(spark, texts + formula + others, patterns=False)
    assert all(got[i] == {"page"} for i in range(len(texts))) and not any(got[i] for i in range(len(texts), len(got)))
    assert not any(kinds(spark, texts[:2], patterns=False).values())


def test_long_traceback_and_long_slot(spark):
    got = kinds(spark, ["Traceback (most recent call last): " + "in render line 5 " * 60, "We turn to {{" + "a very long name " * 30 + "}} now."])
    assert got == {0: {"error"}, 1: {"slot"}}


def test_hot_notice_long_texts_and_repeats(spark):
    texts = ["Please enable JavaScript."] * 200 + ["word " * 200_000 + "\nContent coming soon.\n" + "word " * 10]
    got = kinds(spark, texts)
    assert all(got[i] == {"script", "page"} for i in range(200)) and got[200] == {"filler"}
    df = spark.createDataFrame([(1, "{{x}}", "x", 1, "y")] * 3 + [(None, "{{x}}", "x", 1, "y")], DOCS)
    assert [tuple(r) for r in rs.residue(df).collect()] == [(1, "slot", "pattern")]
    assert rs.residue(df.limit(0)).count() == 0


def test_latin():
    assert rs.latin_filler("nostra labora nisil magnis sedum consta omet tempra quist nostra elitra omet".split())
    assert not rs.latin_filler("the minister will have to defend the commission against the officials of the house".split())


def test_small_tables(spark, data):
    docs = table(spark, data, "documents")
    n = docs.count()
    assert 0 < rs.residue(docs).select("doc_id").distinct().count() < 0.2 * n
    assert 0 < lk.leaked_items(docs, table(spark, data, "eval_items")).count() < n
