"""What each operator finds in small cases, against brute force or round trips where there is one."""

import random

import numpy as np
import pytest
from tables import row, transcript, write

from attestant.llm import common, encoding, language, leaks, mixing, names, pii, quality, scans, speech
from attestant.llm import queries as Q

FINDER = pii.Finder(["kestrel", "milica", "bill"])


def kinds(text):
    return {k for _, _, k in FINDER.spans(text, FINDER.anchors([text]).get(0, []))}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A. My email is k.rurirow+work@uni.morvale.example.", {"email"}), ("A. It went to k_r at uni dot morvale dot example and", {"email"}), ("We bought twelve of them @ 14 dollars.", set()),
        ("Q. Did you call (555) 555-0109 that night?", {"phone"}), ("five five five, zero, one, eight, one.", {"phone"}), ("Is 1-555-555-0108, ext. 7 yours?", {"phone"}), ("A. Mi teléfono es el +34-600-55-51-54.", {"phone"}),
        ("A. My social is 971-02-6854.", {"id_number"}), ("Is X6233816 the number on your card?", {"id_number"}), ("El carné lleva el número 86843981G.", {"id_number"}), ("Mon numéro est le 1 25 00 99 854 218 81.", {"id_number"}),
        ("Invoice 2247 511 826 was never paid.", set()), ("Serial number 3849-94-5940 was on the pump.", set()), ("See Bates page TWC-6455-7962.", set()), ("That is docket 19-CV-1793-88.", set()), ("under § 14 of the lease at 7:30", set()),
        ("A. I live at 9282 Tollhouse Row, Apt. 4B.", {"address"}), ("A. Vivo en calle Tres Molinos, número 57.", {"address"}), ("au 179 avenue des Trois Écluses.", {"address"}), ("It is on Quarrymoor Street somewhere.", set()),
        ("BY MS. STAGAGER:", {"name"}), ("KEFUNE, J. - Were you there?", {"name"}), ("THE WITNESS: Yes.", set()), ("COUNSEL FOR TOGALLOUX QUARRY LIMITED: I object.", set()), ("Q. And did Milica K. Fundolis say why?", {"name"}), ("A. Ms. Fozoger told me so.", {"name"}), ("Interviewer: What was it?", set()), ("A: The concrete was new.", set()),
    ],
)
def test_personal_information(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("text", ["It is two oh two four one eight nine six.", "Es dos uno ocho cuatro seis nueve.", "Eins, zwei, drei, vier, sechs, sieben.", "un-deux-quatre-six-huit-neuf"])
def test_every_number_word_is_an_anchor(text):
    assert kinds(text) == {"phone"}


@pytest.mark.parametrize(("text", "want"), [("My card is 4111 1111 1111 1111.", {"id_number"}), ("My card is 4111 1111 1111 1112.", set()), ("Pay to GB82 WEST 1234 5698 7654 32 by noon.", {"id_number"}), ("Pay to GB83 WEST 1234 5698 7654 32 by noon.", set()), ("Write to a.b@x.y.example, please.", {"email"})])
def test_accounts_by_their_check_digits(text, want):
    assert kinds(text) == want


def test_spans_are_expanded_from_anchors_in_long_texts():
    word = "the clerk wrote it all down and nobody read it "
    pieces = {"email": "a.b@c.example", "phone": "(555) 555-0109", "address": "9282 Tollhouse Row"}
    text = (word * 400).join(["", *(f"{v} " for v in pieces.values()), ""])
    found = FINDER.spans(text, FINDER.anchors([text])[0])
    assert [(text[a:b], k) for a, b, k in found] == [(v, k) for k, v in pieces.items()]
    own = FINDER.anchors([text])[0]
    assert all(hi - lo < 400 for lo, hi, _ in pii.windows(text, own, pii.DIGIT)) and pii.windows(text, own, pii.TITLE) == []


@pytest.mark.parametrize("title", pii.TITLES)
def test_every_title_is_an_anchor(title):
    assert kinds(f"I told {title.capitalize()}. Varga so.") == kinds(f"I told {title.capitalize()} Varga so.") == {"name"}


def test_placeholders_keep_the_rest():
    text = "A. Call 555-0130 or write to a.b@c.example, please."
    assert pii.replace(text, FINDER.spans(text, FINDER.anchors([text])[0])) == "A. Call [PHONE] or write to [EMAIL], please."


@pytest.mark.parametrize(("field", "is_name"), [("Xiomara Skazudell, tel. 555.555.0164", True), ("[NAME REDACTED]", False), ("THE REPORTER", False), ("Grain Storage, Kragasen (Inc.)", False), ("The Vavulund Insurance Brokers Co", False), ("MS. PAGATON", True), ("", False)])
def test_name_fields(field, is_name):
    assert pii.name_in_field(field) is is_name


ORIGINAL = ["Où est l’entrepôt ? Près du café…", "Ich weiß noch, dass der Prüfer überprüft", "não encontrou o caminhão à noite", "Знаете ли вы, почему крановщик", "क्या यह सच है कि हमारे", "السائق راجع عقد الإيجار", "a fee of €250, “as-is”"]


@pytest.mark.parametrize("text", ORIGINAL)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp437", "mac_roman", "cp1250"])
def test_encoding_round_trip(text, wrong):
    garbled = encoding.misread(text, wrong)
    assert encoding.spans(garbled) and encoding.restore(garbled) == text


@pytest.mark.parametrize("text", [*ORIGINAL, "São Vento É verdade", "MR. MOTUKJÆR: Søren", "voorgaande vóór één", "an x¬\ny", "the ofﬁcer, a ﬂood"])
def test_right_text_is_left_alone(text):
    assert encoding.spans(text) == []


def test_one_byte_encodings_of_other_scripts():
    assert encoding.restore("Наша контора видела".encode("cp1251").decode("latin-1")) == "Наша контора видела"
    assert encoding.spans("the crew�s words") == [(8, 9, "�")]


@pytest.mark.parametrize(("text", "right", "wrong"), [("le café fermé du château", "mac_roman", "cp1252"), ("der schöne Garten über dem Fluß und Müller", "cp850", "cp1252"), ("la señora está mañana", "cp437", "latin-1"), ("le garçon répète", "cp1252", "mac_roman"), ("über schöne Gärten", "cp1252", "cp850")])
def test_one_byte_encodings_of_latin_script(text, right, wrong):
    garbled = "".join(encoding._bytes(wrong)[b] if b > 127 else chr(b) for b in text.encode(right))
    found = encoding.spans(garbled)
    assert found and all(text[a:b] == c or c == encoding.LOST for a, b, c in found)
    # what is strange where it stands is put right
    assert sum(c != encoding.LOST for *_, c in found) >= max(1, len(found) - 1)


@pytest.mark.parametrize(("right", "wrong"), [("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1252"), ("iso8859-5", "latin-1")])
def test_one_byte_encodings_of_cyrillic(right, wrong):
    text = "Наша контора видела старого крановщика"
    assert encoding.restore(text.encode(right).decode(wrong, "replace")).count("\ufffd") or encoding.restore(text.encode(right).decode(wrong)) == text


def test_mixed_text_keeps_its_right_part():
    assert encoding.restore("naïve rÃ©union ’ok’") == "naïve réunion ’ok’"


def test_language_field_labels_switched_text():
    en = "the driver returned the keys before the meeting and nobody wrote it down in the office that morning".split()
    es = "el conductor devolvió las llaves antes de la reunión y nadie lo anotó en la oficina esa mañana".split()
    rng = random.Random(3)
    sample = [(" ".join(rng.choices(en, k=9)), "en") for _ in range(150)] + [(" ".join(rng.choices(es, k=9)), "es") for _ in range(150)]
    noisy = [(t, "es" if i % 10 == 0 else x) for i, (t, x) in enumerate(sample)]
    model = language.train(language.cleaned(noisy), [("en", "the"), ("es", "el")])
    m = model.marginals([[*en[:6], *es[:6]]])[0]
    assert [model.languages[k] for k in m.argmax(1)].count("en") in (5, 6, 7) and m[0].argmax() == model.languages.index("en") and m[-1].argmax() == model.languages.index("es")
    assert np.allclose(m.sum(1), 1)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.random((1, 4, 3)), rng.random((3, 3))
    want = np.zeros((4, 3))
    import itertools

    for path in itertools.product(range(3), repeat=4):
        p = np.prod([e[0, i, s] for i, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:], strict=False)])
        for i, s in enumerate(path):
            want[i, s] += p
    got = language.forward_backward(e, t, np.ones((1, 4), bool))[0][0]
    assert np.allclose(got, want / want.sum(1, keepdims=True))


@pytest.mark.parametrize(
    ("text", "want", "ts", "filler", "sound"),
    [
        ("[00:59:00] DR. X - As you know, the contractor", "DR. X - As you know, the contractor", True, False, False), ("{59.06} when the", "when the", True, False, False), ("59m21s", "", True, False, False), ("01:01:38,395 --> 01:01:42,422", "", True, False, False), ("missing at 7:30 that morning.", "missing at 7:30 that morning.", False, False, False),
        ("the er, yard clerk", "the yard clerk", False, True, False), ("Do you know you know, whether", "Do you know whether", False, True, False), ("er hat um drei gesagt", "er hat um drei gesagt", False, False, False), ("de este contrato", "de este contrato", False, False, False), ("estimate? [background noise]", "estimate?", False, False, True), ("(Recess taken.)", "(Recess taken.)", False, False, False), ("((unintelligible))", "", False, False, True), ("Reach me at (555) 555-0104", "Reach me at (555) 555-0104", False, False, False),
    ],
)
def test_spoken_text(text, want, ts, filler, sound):
    got = speech.clean(text)
    assert (got[0], got[2], got[3], got[4]) == (want, ts, filler, sound)


def test_precedence_constraints():
    assert speech.order([(2, None, True), (0, None, True), (1, None, True)]) == [1, 2, 0]
    # the numbered rows keep their order though their times say otherwise; the row without number goes where its time puts it
    assert speech.order([(0, 10.0, True), (None, 25.0, True), (1, 5.0, True), (2, 30.0, True)]).index(1) < 3
    assert speech.order([(0, None, True), (None, None, False), (1, None, True)]) in ([0, 1, 2], [0, 2, 1])


def test_times_and_cues_outweigh_row_numbers():
    said = ["Q. Where was it?", "A. At the yard", "by the gate.", "Q. And then?", "A. We left."]
    times = [10.0, 14.0, None, 20.0, 25.0]
    rows = [(k, t, x[1:2] == ".", x) for k, (t, x) in enumerate(zip(times, said, strict=True))]
    assert speech.order(rows) == [0, 1, 2, 3, 4]
    # an answer numbered last with its second row: its time puts it back, and the cue takes the second row along
    moved = [(3, *rows[1][1:]), (4, *rows[2][1:]), (0, *rows[0][1:]), (1, *rows[3][1:]), (2, *rows[4][1:])]
    assert [moved[i][3] for i in speech.order(moved)] == said
    # without its time the row number stands
    assert [moved[i][3] for i in speech.order([(n, None, *r) for n, _, *r in moved])] == [said[k] for k in (0, 3, 4, 1, 2)]


def test_shuffled_row_numbers_are_put_right_by_time():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(5, 20)
        times = [10.0 * k + rng.random() for k in range(n)]
        numbers = list(range(n))
        a, b = rng.sample(range(n), 2)
        numbers[a], numbers[b] = numbers[b], numbers[a]
        assert speech.order([(numbers[k], times[k], True, f"Mr. {k}: Yes.") for k in range(n)]) == list(range(n))


def test_order_is_topological_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randrange(1, 7)
        rows = [(rng.choice([None, *range(4)]), rng.choice([None, float(rng.randrange(6))]), rng.random() < 0.5, rng.choice(["", "and so", "Yes.", "No"])) for _ in range(n)]
        got = speech.order(rows)
        assert sorted(got) == list(range(n))
        # greedy by weight: every constraint kept by brute force holds in the result
        kept: list = []
        import itertools

        for _, a, b in sorted(speech.constraints(rows), key=lambda e: (-e[0], *[sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)).index(x) for x in e[1:]])):
            if any(all(p.index(x) < p.index(y) for x, y in [*kept, (a, b)]) for p in itertools.permutations(range(n))):
                kept.append((a, b))
        assert all(got.index(a) < got.index(b) for a, b in kept)


def test_marks_without_the_hour():
    assert speech.aligned([3968.0, 379.0, 3990.0, None], [False, True, False, False]) == [3968.0, 3979.0, 3990.0, None]
    assert speech.aligned([None, 10.0], [False, True]) == [None, 10.0] and speech.aligned([], []) == []


def test_turns_over_pages(spark):
    rng = random.Random(10)
    said = [(f"d{d}", p, k, rng.choice([None, "a", "a", "b"])) for d in range(8) for p in range(1, 4) for k in range(rng.randrange(0, 4))]
    want, state = {}, {}
    for d, p, k, who in said:
        turn, last = state.get(d, (0, None))
        if turn == 0 or who is not None and who != last:
            turn += 1
        state[d] = (turn, who or last)
        want[d, p, k] = turn
    got = speech.with_turns(spark.createDataFrame(said, "doc_id string, page int, place int, person string")).collect()
    assert {(r["doc_id"], r["page"], r["place"]): r["turn_no"] for r in got} == want


def test_names():
    p = names.Parser(["castor", "milica"])
    assert p.parse("PAKICOURT, CASTOR F.")[1:3] == ("pakicourt", ("castor",)) == p.parse("Pakicourt Castor")[1:3] == p.parse("Castor  Pakicourt, tel. 555-0101")[1:3]
    assert p.parse("MS. B. SKAKARIC")[1:4] == ("skakaric", ("b",), "ms") and p.parse("THE COURT") is None and p.parse("[REDACTED]") is None
    assert p.parse("Kuzafeld Grain Stor. Co.")[4] == p.parse("COUNSEL FOR THE KUZAFELD GRAIN STORAGE")[4]
    assert p.parse("MS. FERUHURST <THEODORE.FERUHURST+WORK@POST.OSTREL.TEST>")[2] == ("theodore",) and p.parse("MR. HELUMERE <helumere_l @ x.example>")[2] == ("l",) and p.parse("MR. ZOD <czod at x dot example>")[2] == ("c",)
    assert names.word_similarity("bill", "william") == 1.0 and names.word_similarity("kit", "christopher") == 1.0 and names.word_similarity("walter", "perrin") < 0.5
    n = names.bands()
    assert 1 - (1 - names.SIMILARITY**names.ROWS) ** n >= names.RECALL > 1 - (1 - names.SIMILARITY**names.ROWS) ** (n - 1)


def test_banding_recall_on_typos():
    rng = random.Random(5)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + rng.choice(["mont", "gate", "lund"]) for _ in range(200)]
    found = 0
    for w in words:
        i = rng.randrange(1, len(w) - 1)
        typo = w[:i] + rng.choice("aeiourst") + w[i + 1 :]
        found += any(a == b for a, b in zip(names.signature(w, names.bands()), names.signature(typo, names.bands()), strict=True))
    assert found >= 190


def test_every_accepted_edit_of_a_short_name_is_a_candidate(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))[: rng.choice((4, 5, 6))] for _ in range(150)]
    said, want = set(), set()
    for k, w in enumerate(words):
        i = rng.randrange(1, len(w) - 2) if len(w) > 4 else rng.randrange(1, 3)
        typo = w[:i] + w[i + 1] + w[i] + w[i + 2 :] if len(w) > 4 and k % 3 else w[:i] + "z" + w[i + 1 :] if k % 2 else w[:i] + w[i] + w[i:]
        if typo != w:
            said |= {(f"m{k}", "person", w), (f"m{k}", "person", typo)}
            want |= {(f"m{k}", "person", w, typo), (f"m{k}", "person", typo, w)}
    got = names.spelling_pairs(spark.createDataFrame(sorted(said), "matter_id string, kind string, main string"))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize(("word", "right"), [("tlie", "the"), ("vvas", "was"), ("thc", "the"), ("missmg", "missing"), ("5umrnatv", "summary"), ("fxamination", "examination"), ("purnp", "pump"), ("woulcl", "would"), ("vyeigh", "weigh"), ("rootn", "room"), ("sorue", "some"), ("elown", "down"), ("bke", "like")])
def test_misread_words(word, right):
    assert scans.misread_as(word, right) and scans.anagram(right) in scans.differences(word)


def test_words_that_are_not_misread():
    assert scans.misread_as("pump", "tank") is None and scans.misread_as("the", "the") == 0


def test_repair_of_a_row():
    assert scans.repaired("Q. Was tlie old foun-", {"tlie": "the"}, "foundation", False) == "Q. Was the old foundation"


def brute(text, item):
    a, b = [w.lower().strip(".,") for w in text.split()], [w.lower().strip(".,") for w in item.split()]
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_leaks_against_brute_force():
    rng = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in ("mar", "tol", "ves", "kin") for b in ("den", "gos", "pir") for c in ("tal", "mek", "rund")]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(5)]
    index = leaks.Index(items)
    for n in (5, 12, 16, 17, 18, 19, 25, 40):
        for i, item in items:
            start = rng.randrange(0, 41 - n)
            text = " ".join([*rng.choices(vocab, k=20), *item.split()[start : start + n], *rng.choices(vocab, k=20)])
            codes, _ = leaks.tokens(text)
            h = leaks.windows(codes)
            got = {index.ids[k] for k, *_ in index.leaks(codes, h, index.hits(h))}
            assert got == {j for j, t in items if brute(text, t) >= leaks.LEAST_WORDS}, (n, i)


def test_leaks_through_scan_noise():
    item = "Whoever inherits a mill near the river must weigh bread against pebbles ninety times until a magistrate ruled that four brass thimbles settle any quarrel"
    index = leaks.Index([(7, item)])
    for text in (item.upper(), item.replace("th", "tb").replace("rn", "m").replace("ll", "ll"), "\n".join(item[i : i + 30] + ("-" if item[i + 29 : i + 31].isalpha() else "") for i in range(0, len(item), 30)), item.replace("bread", "8rexd")):
        codes, _ = leaks.tokens(text)
        h = leaks.windows(codes)
        assert [index.ids[k] for k, *_ in index.leaks(codes, h, index.hits(h))] == [7]


def test_items_that_share_a_frame_leak_only_by_their_own_words():
    frame = "In the tidal calendars of {} and {}, the {} people weighed {} against river stones {}, {} a single lamp from {} settles any quarrel over hay."
    fills = [("Marden", "Tolgos", "barefoot", "bread", "ninety times", "yet the ledger shows", "Vespir"), ("Kinrund", "Vestal", "stubborn", "chalk", "eighteen nights", "and for that reason", "Tolmek")]
    items = [(k, frame.format(*f) + " " + frame.format(*f[::-1])) for k, f in enumerate(fills)]
    index = leaks.Index(items)
    for k, text in items:
        noisy = text.replace("people", "peopla").replace("weighed", "weiqhod").replace("quarrel", "quarel")
        codes, _ = leaks.tokens(noisy)
        h = leaks.windows(codes)
        assert {index.ids[x] for x, *_ in index.leaks(codes, h, index.hits(h))} == {k}


def test_every_passage_of_an_item_is_cut_out(spark, tmp_path):
    rng = random.Random(4)
    item = rng.sample([f"{a}{b}{c}" for a in ("mar", "tol", "ves", "kin") for b in ("den", "gos", "pir") for c in ("tal", "mek", "rund", "bost")], 44)
    advert = "Buy the new soap of Messrs Quagg today at every good shop in town".split()
    pages = {1: [*item, *advert, *item], 2: [*item[:22], *advert, *item[22:]], 3: [*item[:20], *advert, *item[:30]], 4: advert, 5: [*item[:20], *advert, *item[30:40]]}
    folder = write(spark, tmp_path, documents=[{"doc_id": k, "text": " ".join(w)} for k, w in pages.items()], eval_items=[{"item_id": 1, "text": " ".join(item)}])
    got = {r["doc_id"]: r["text"].split() for r in Q.p8_cleaned(spark, folder).collect()}
    assert got == {1: advert, 2: advert, 3: advert, 5: [*advert, *item[30:40]]}  # ten words are no leak
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "eval_items")]
    assert sorted(map(tuple, leaks.leaked(*tables).collect())) == [(1, 1, 44), (2, 1, 22), (3, 1, 30), (5, 1, 20)]


def test_reading_order():
    assert leaks.in_columns("a\nc\nb\nd", [0, 1, 2, 3], [10, 300, 12, 301], [5, 6, 20, 21]) == "a\nb\nc\nd"


def test_lines_read_across_columns():
    merged = "THE PAGE TITLE\nthe council met on Monday evening   and it was decided that the\nold bridge should be closed before   winter came to the town."
    assert common.unmerged(merged) == "THE PAGE TITLE\nthe council met on Monday evening\nold bridge should be closed before\nand it was decided that the\nwinter came to the town."
    assert common.unmerged(TABLE.replace("  ", "   ")) == TABLE.replace("  ", "   ") and common.unmerged("a\nb") == "a\nb"


def test_sainte_lague():
    assert mixing.sainte_lague([53.0, 24.0, 23.0], 7, [99] * 3) == [3, 2, 2]
    assert mixing.sainte_lague([0.5, 0.5, 0.0], 10, [2, 99, 99]) == [2, 8, 0]
    rng = random.Random(1)
    for _ in range(50):
        w = [rng.random() for _ in range(rng.randrange(1, 8))]
        seats = rng.randrange(0, 60)
        got = mixing.sainte_lague(w, seats, [1000] * len(w))
        order = sorted(((-x / (2 * k + 1), i) for i, x in enumerate(w) for k in range(seats)))[:seats]
        assert got == [sum(i == j for _, j in order) for i in range(len(w))]


def test_mixture(spark, tmp_path):
    docs = [{"doc_id": i, "text": "one two three four five " * 20, "source": "big" if i < 80 else "small" if i < 90 else None} for i in range(100)]
    folder = write(spark, tmp_path, documents=docs, mix_targets=[{"source": "big", "target_share": 0.5, "max_repeats": 1}, {"source": "small", "target_share": 0.5, "max_repeats": 3}, {"source": "none", "target_share": 0.0, "max_repeats": 1}])
    rows = Q.p9_mixture(spark, folder).collect()
    assert max(r["copies"] for r in rows if r["source"] == "small") <= 3 and {r["copies"] for r in rows if r["source"] == "big"} == {1}
    shares = {r["source"]: r["actual_share"] for r in Q.p9_shares(spark, folder).collect()}
    assert shares["none"] == 0 and abs(sum(shares.values()) - 1) < 1e-9 and 0.2 < shares["small"] < 0.4


def test_mixture_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    docs = [(k, rng.choice(["big"] * 8 + ["mid"] * 3 + ["low"]), " ".join(["word"] * rng.randrange(1, 60))) for k in range(900)]
    docs += [(1000, "tiny", "one two")]
    listed = [("big", 0.3, 1), ("mid", 0.4, 3), ("low", 0.2, 2), ("tiny", 0.1, 2)]
    df, mix = spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(listed, "source string, target_share double, max_repeats int")
    got = {r["doc_id"]: r["copies"] for r in mixing.mixture(df, mix).collect()}
    assert got[1000] == 2  # a source smaller than a block is not left out
    counted = mixing.counted(df).filter("tokens > 0").select("*", F.xxhash64(F.lit(17), "doc_id").alias("o"), F.xxhash64(F.lit(18), "doc_id").alias("s")).collect()
    total = sum(r["tokens"] for r in counted)
    block = max(1, -(-total // mixing.BLOCKS))
    have = {s: sum(r["tokens"] for r in counted if r["source"] == s) for s, *_ in listed}
    shards: dict = {}
    for r in sorted(counted, key=lambda r: (r["o"], r["doc_id"])):
        shards.setdefault((r["source"], r["s"] % max(1, have[r["source"]] // (mixing.BLOCKS_PER_SHARD * block))), []).append(r)
    assert sum(s == "big" for s, _ in shards) > 1
    want = {}
    for q in mixing.quotas([{"source": s, "shard": k, "tokens": sum(r["tokens"] for r in v)} for (s, k), v in shards.items()], {s: (t, n) for s, t, n in listed}, total, block):
        left = q["wanted"]
        for copy in range(1, q["repeats"] + 1):
            for r in shards[q["source"], q["shard"]]:
                if left > 0:
                    want[r["doc_id"]] = copy
                    left -= r["tokens"]
    assert got == want


def test_more_than_forty_languages(spark, tmp_path):
    codes = [f"{a}{b}" for a in "qxy" for b in "abcdefghijklmnop"][:45]
    said = {c: "".join(random.Random(k).choices("bdfgklmnprst", k=2)) for k, c in enumerate(codes)}
    rows, lines, context = [], [], []
    for c in codes:
        for d in range(3):
            r, x = row(f"{c}{d}", 1, 0, f"{said[c]}a {said[c]}o mi{said[c]}u {said[c]}ek {said[c]}on", "answer")
            rows, lines = [*rows, r], [*lines, x]
            context.append({"doc_id": f"{c}{d}", "language_hint": (c, None, None, None)})
    folder = write(spark, tmp_path, canonical_rows=rows, transcript_lines=lines, doc_context=context)
    sample = language.sample_rows(spark.read.parquet(f"{folder}/canonical_rows.parquet"), spark.read.parquet(f"{folder}/doc_context.parquet"))
    assert {x for _, x in sample} == set(codes) and len(sample) == 3 * len(codes)


def test_letter_pairs_of_all_pages(spark):
    texts = ["The cat sat.\nOn a mat", "été à l’eau", "", None, "12 ab-cd", "日本"]
    some = [t for t in texts if t]
    lines = quality.Lines(some, np.zeros(0, np.uint64)).pair_counts()
    assert (quality.letter_pairs(some) == lines).all() and lines.sum() > 10
    assert (quality.pair_counts(spark.createDataFrame([(t,) for t in texts], "text string")) == lines).all()


PROSE = "The council met on Monday evening and it was decided\nthat the old bridge should be closed before the winter,\nthough a few of the members were against the plan.\nNo further business was brought before the meeting.\n"
LIST = "PRIZE LIST\n" + "\n".join(f"{i}. Barley" for i in range(1, 12))
TABLE = "Train  dep.  arr.  class\n" + "\n".join(f" {i}  {i}.01  {i}.17  1  3½" for i in range(10, 24))
JUNK = "\n".join(["¦/¦.^•/¦\\1,;^:I \"\\*’ *¦¦-•1/", "-|*/*¦^l•~I :;\"°1", "\",’*\\1¦|°;^"] * 4)


def test_page_kinds(spark, tmp_path):
    docs = [{"doc_id": i, "text": t} for i, t in enumerate([PROSE * 3, LIST, TABLE, JUNK, PROSE * 3 + LIST[:40], PROSE.split(".")[0] + "\n" + LIST, ""] + [PROSE * 4] * 20 + [LIST, TABLE, JUNK] * 5)]
    words = [{"lang": "en", "word": w, "freq_rank": i} for i, w in enumerate("the of and to a in was on it that before though were".split())]
    folder = write(spark, tmp_path, documents=docs, common_words=words)
    got = {r["doc_id"]: r["kind"] for r in Q.p10_found(spark, folder).collect()}
    assert {k: v for k, v in got.items() if k < 7} == {1: "list", 2: "table", 3: "junk", 5: "list"}
    stats = {r["doc_id"]: r for r in Q.p10_statistics(spark, folder).collect()}
    assert stats[0]["words"] == len(PROSE.split()) * 3 and stats[6]["words"] == 0
    assert abs(stats[0]["mean_word_length"] - np.mean([len(w.strip(".,")) for w in PROSE.split()])) < 1e-9


def test_viterbi_against_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    scores, trans, first = rng.normal(size=(5, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    best = max(itertools.product(range(4), repeat=5), key=lambda p: first[p[0]] + sum(scores[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)))
    out = np.zeros(5, np.int8)
    quality.out_part(scores, np.array([0]), np.array([5]), trans, first, out)
    assert tuple(out) == best


def test_conversation_defects_and_links(spark, tmp_path):
    good = transcript(row("good", 1, 0, "Q. Where is the old pump?", "question", event_kind="question_marker", pid="p1"), row("good", 1, 1, "A. The pump is outside.", "answer", event_kind="answer_marker", pid="p2"), row("good", 2, 0, "Q. Who saw it?", "question", event_kind="question_marker", pid="p1"), row("good", 2, 1, "MR. X: Objection.", "objection", event_kind="speaker_anchor", pid="p3"), row("good", 2, 2, "A. Nobody.", "answer", event_kind="answer_marker", pid="p2"))
    silent = transcript(row("silent", 1, 0, "Q. Where?", "question", event_kind="question_marker"), row("silent", 1, 1, "Q. Who?", "question", event_kind="question_marker"), row("silent", 1, 2, "A. I.", "answer", event_kind="answer_marker"))
    torn = transcript(row("torn", 1, 0, "Q. Where?", "question", event_kind="question_marker"), row("torn", 1, 2, "A. There.", "answer", event_kind="answer_marker"))
    blank = transcript(row("blank", 1, 0, " ", "answer"), row("blank", 1, 1, "00012"))
    context = [{"doc_id": d, "page_count": n} for d, n in (("good", 2), ("silent", 1), ("torn", 1), ("blank", 1), ("absent", 1))]
    frames = [{"doc_id": "good", "physical_page": 1, "row_ids": ["p1_r1", "p1_r2"]}, {"doc_id": "good", "physical_page": 2, "row_ids": ["p2_r1", "p2_r2", "p2_r3"]}]
    rows = [r for t in (good, silent, torn, blank) for r in t[0]]
    lines = [x for t in (good, silent, torn, blank) for x in t[1]]
    folder = write(spark, tmp_path, canonical_rows=rows * 2, transcript_lines=lines, doc_context=context, page_frames=frames)
    assert {(r["doc_id"], r["defect"]) for r in Q.p3_found(spark, folder).collect()} == {("silent", "no_reply"), ("torn", "broken"), ("blank", "empty"), ("absent", "empty")}
    turns = Q.p3_conversations(spark, folder).orderBy("turn_no").collect()
    assert [(t["turn_no"], t["parent"]) for t in turns] == [(1, None), (2, 1), (3, None), (4, 3), (5, 3)]


def test_interleaved_channels(spark, tmp_path):
    def ask(k, who, label, text):
        return row("two", 1, k, f"{label}: {text}", "question", event_kind="question_marker", pid=who, label=label)

    def say(k, text):
        return row("two", 1, k, text, "answer", event_kind="answer_marker", pid="w", label="MS. ADLER")

    told = [
        ask(0, "a", "MR. BRANDT", "When did the harbour crane fail?"), ask(1, "b", "MS. CORVIN", "Who kept the purchase ledger?"),
        say(2, "Mr. Brandt, the harbour crane did fail in March."),  # to the question before the latest: by name and words
        ask(4, "a", "MR. BRANDT", "Was the crane inspected?"), ask(5, "b", "MS. CORVIN", "Which pages were missing?"),
        say(6, "The crane was inspected."),  # words alone are no ground to pass over a question
        ask(7, "a", "MR. BRANDT", "Did you sign the crane manual?"), ask(8, "a", "MR. BRANDT", "And where were you?"),
        say(9, "Mr. Brandt, I did sign the crane manual."),  # the same speaker's later question closed the earlier one
    ]
    rows, lines = transcript(*told)
    folder = write(spark, tmp_path, canonical_rows=rows, transcript_lines=lines, doc_context=[{"doc_id": "two", "page_count": 1}])
    from attestant.llm import conversations as C

    turned = C.turns(C.pages(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("canonical_rows", "transcript_lines", "page_frames")), with_text=True))
    text = {r["turn_no"]: r["text"] for r in turned.collect()}
    got = {text[r["turn_no"]][:20]: text[r["parent"]][:12] for r in C.reply_links(turned).collect()}
    assert len(got) == 3
    parent = {r["turn_no"]: r["parent"] for r in C.reply_links(turned).collect()}
    assert sorted(parent.values()) == [1, 5, 8]


def test_interview_turns(spark, tmp_path):
    rows, lines = transcript(row("iv", 1, 0, "MR. KEFUNE: What was um, new", "question", label="MR. KEFUNE", pid="p1", anchor=True, event_kind="speaker_anchor"), row("iv", 1, 1, "[00:10:05] about it?", "question"), row("iv", 1, 2, "(door slams)", "parenthetical"), row("iv", 1, 3, "Witness: Nothing.", "answer", label="Witness", anchor=True, event_kind="speaker_anchor"), row("iv", 2, 0, "THE WITNESS: At all.", "answer", label="THE WITNESS", pid="p2", anchor=True, event_kind="speaker_anchor"))
    people = [{"doc_id": "iv", "id": "p1", "observed_labels": ["MR. KEFUNE"]}, {"doc_id": "iv", "id": "p2", "observed_labels": ["Witness", "THE WITNESS"]}]
    folder = write(spark, tmp_path, canonical_rows=rows, transcript_lines=lines, participants=people, doc_context=[{"doc_id": "iv", "document_type": "interview", "page_count": 2}])
    got = {(r["row_id"], r["finding"]) for r in Q.p4_found(spark, folder).collect()}
    assert got == {("p1_r1", "turn"), ("p1_r1", "filler"), ("p1_r2", "timestamp"), ("p1_r3", "sound"), ("p1_r4", "turn")}
    assert [r["text"] for r in Q.p4_turns(spark, folder).orderBy("turn_no").collect()] == ["What was new about it?", "Nothing. At all."]


def test_linked_names(spark, tmp_path):
    said = [(1, "Castor Pakicourt", "MS. PAKICOURT"), (2, "Pakicourt Castor", "MS. PAKICOURT"), (3, "PAKICOURT, CASTOR F., tel. 555-0101", "THE WITNESS"), (4, "Casstor Pakicourt", "MS. PAKICOURT"), (5, "Milica Pakicourt", "MR. PAKICOURT"), (6, "C. Pakicuort", "MS. C. PAKICUORT"), (7, None, "THE REPORTER"), (8, "Kuzafeld Grain Storage Co.", "COUNSEL FOR KUZAFELD GRAIN STOR."), (9, "The Kuzafeld Grain Storage", "COUNSEL FOR X"), (10, "Kuzafeld Freight Inc", "THE COURT"), (11, "[NAME REDACTED]", "[REDACTED]")]
    people = [{"participant_key": k, "matter_id": "m", "doc_id": f"d{k}", "canonical_name": n, "display_label": x, "observed_labels": [x]} for k, n, x in said]
    others = [{"participant_key": 100 + i, "matter_id": f"o{i}", "doc_id": "z", "canonical_name": f"{g} Zed{c}lund"} for i, (g, c) in enumerate((g, c) for g in ("Castor", "Milica") for c in "abcdefgh")]
    folder = write(spark, tmp_path, participants=people * 2 + others)
    got = {(r["key_a"], r["key_b"]) for r in Q.p5_found(spark, folder).collect()}
    same = (1, 2, 3, 4, 6)
    assert got == {(a, b) for a in same for b in same if a < b} | {(8, 9)}


def test_linking_names_broadcasts_nothing(spark, tmp_path, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(names, "cut_lineage", lambda df, cut=names.cut_lineage: plans.append(plan(df)) or cut(df))
    folder = write(spark, tmp_path, participants=[{"participant_key": k, "matter_id": "m", "doc_id": f"d{k}", "canonical_name": n} for k, n in enumerate(("Castor Pakicourt", "Castor Pakicuort", "Milica Pakicourt", "Castor Zedlund"))])
    found = Q.p5_found(spark, folder)
    plans.append(plan(found))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert [(r["key_a"], r["key_b"]) for r in found.collect()] == [(0, 1)]


def test_stars_of_many_rounds_keep_a_small_plan(spark):
    # a path of falling weights gives one star a round: every second spelling becomes a centre, the one after it goes to it
    n = 19
    said = spark.createDataFrame([("m", "person", f"w{k:02}", n - k) for k in range(n)] + [("m", "person", "alone", 1)], "matter_id string, kind string, main string, weight long")
    edges = spark.createDataFrame([("m", "person", f"w{a:02}", f"w{b:02}") for a in range(n) for b in (a - 1, a + 1) if 0 <= b < n], "matter_id string, kind string, a string, b string")
    got = names.stars(said, edges)
    assert {(r["main"], r["centre"]) for r in got.collect()} == {(f"w{k:02}", f"w{k // 2 * 2:02}") for k in range(n)} | {("alone", "alone")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1

def test_scan_noise(spark, tmp_path):
    clean = [row(f"c{i}", 1, k, t, "answer")[0] for i in range(6) for k, t in enumerate(["The pump was at the station before the meeting.", "It was there and the foundation was new."])]
    rows, lines = transcript(row("s", 1, 0, "In re Pump Claims", source="ocr"), row("s", 1, 1, "Page l2 of 34", source="ocr"), row("s", 1, 2, "Q. Was tlie foun-", "question", source="ocr", event_kind="question_marker"), row("s", 1, 3, "dation new?", "question", source="ocr"), row("s", 1, 4, "A. That is so-", "answer", source="ocr", event_kind="answer_marker"), row("s", 1, 5, "Q. The pump was there?", "question", source="ocr", event_kind="question_marker"))
    folder = write(spark, tmp_path, canonical_rows=clean + rows, transcript_lines=lines)
    got = {(r["row_id"], r["noise"]) for r in Q.p7_found(spark, folder).collect()}
    assert got == {("p1_r1", "header"), ("p1_r2", "page_number"), ("p1_r3", "misread"), ("p1_r3", "hyphen")}
    assert "Q. Was the foundation new?" in [r["text"] for r in Q.p7_paragraphs(spark, folder).collect()]
