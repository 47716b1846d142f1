import random

from logsluice.llm import sentences as s


def plain(rows):
    """(id, removed, cleaned text) by row, from runs as word lists; rows of equal id and text are one."""
    places = {}
    for key, text in set(rows):
        spans = s.sentences(text or "")
        words = [s._words((text or "")[a:b].lower()) for a, b in spans]
        for i in range(len(words)):
            for n in range(s.LEAST_SENTENCES, len(words) - i + 1):
                if sum(map(len, words[i : i + n])) >= s.LEAST_WORDS:
                    run = tuple(w for x in words[i : i + n] for w in x)
                    places.setdefault(run, set()).add((-1 if key is None else key, text, i, n))
                    break
    gone = {}
    for at in places.values():
        first = min(k for k, *_ in at)
        some = [t for k, t, *_ in at if k == first]
        assert len(set(some)) == 1  # else the hash of the text decides
        least = min(i for k, _, i, _ in at if k == first)
        for k, t, i, n in at:
            if (k, i) != (first, least):
                gone.setdefault((k, t), set()).update(range(i, i + n))
    out = []
    for key, text in rows:
        hit, parts = gone.get((-1 if key is None else key, text), set()), s.sentences(text or "")
        out.append((key, len(hit), "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in hit).rstrip() if hit else text))
    return out


def by_row(rows):
    return sorted(rows, key=repr)


def test_sentences_make_up_the_text():
    for text in ("", "a", " x" * 300, "ab cd ef gh " * 40, "A b. C d! E?\n\nF\ng.h i", " lead. ", "...\n..."):
        assert "".join(text[a:b] for a, b in s.sentences(text)) == text


def test_against_brute_force(spark, documents, corpus, odd):
    rng = random.Random(6)
    passages = [" ".join(f"{'w' * rng.randrange(1, 4)}{rng.randrange(99)}" + (". And" if rng.random() < 0.15 else "") for _ in range(60)) + "." for _ in range(4)]
    rows = [(k, t) for k, t in odd if k != 5] + [(100 + k, t) for k, t in corpus[:80]]
    for k in range(40):
        words = " ".join(f"v{rng.randrange(500)}" for _ in range(30))
        rows.append((1000 + k, f"{words}. {rng.choice(passages)} {words[::-1]}." if k % 2 else words + "."))
    expected = plain(rows)
    found = s.cleaned(documents(rows)).collect()
    assert by_row((r.doc_id, r.n_removed, r.text) for r in found) == by_row(expected)
    changed = {r.doc_id for r in s.cleaned(documents(rows), changed_only=True).collect()}
    assert changed == {k for k, n, _ in expected if n} and len(changed) > 12
    clean = {k for k, n, _ in expected if not n}
    assert {1000 + k for k in range(0, 40, 2)} <= clean


def test_equal_ids_and_empty(spark, documents):
    text = "one two three four five six seven eight nine ten eleven twelve. thirteen fourteen fifteen sixteen and eight more words to make it twenty four in all."
    assert [r.n_removed for r in s.cleaned(documents([(5, text), (5, text)])).collect()] == [0, 0]
    assert sorted((r.doc_id, r.n_removed, r.text) for r in s.cleaned(documents([(5, text), (6, text.upper())])).collect()) == [(5, 0, text), (6, 2, "")]
    assert s.cleaned(documents([])).count() == 0


def test_query_returns_every_document(spark, corpus):
    found = s.op5_sentences(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_sentences", "n_removed", "text"]
    assert by_row((r.doc_id, r.n_removed, r.text) for r in found.collect()) == by_row(plain(corpus))


A = "One short note for all. Call me soon at home. " * 2 + "Bring nothing but your own red pen and some good paper."
B = "This text stands nowhere else in the world. It has two sentences of its own, which is enough for runs of them."


def test_unequal_texts_of_one_id_lose_only_what_repeats(spark, documents):
    found = s.cleaned(documents([(1, A), (7, A), (7, B), (None, B + " And more."), (9, A)])).collect()
    texts = {(r.doc_id, r.n_sentences): r.text for r in found}
    assert texts[None, 3] == B + " And more." and texts[7, 2] == "" and texts[9, 5] == "" and texts[7, 5] == ""
    assert texts[1, 5].startswith("One short note for all. Call me soon at home. ") and len(texts) == 5
    assert {r.text for r in s.cleaned(documents([(1, A), (7, A), (7, B)])).collect()} == {texts[1, 5], "", B}


def test_a_run_in_every_text_and_texts_without_spaces(spark, documents):
    rng = random.Random(8)
    own = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    rows = [(k, f"{B} {own()}") for k in range(40)]
    passage = own()
    rows += [(100 + k, own() + passage + own()) for k in range(3)]
    found = {r.doc_id: r for r in s.cleaned(documents(rows)).collect()}
    assert found[0].n_removed == 0 and all(found[k].text == rows[k][1][len(B) + 1 :] for k in range(1, 40))
    assert by_row((r.doc_id, r.n_removed, r.text) for r in found.values()) == by_row(plain(rows))
    assert passage[60:140] in found[100].text and all(passage[60:140] not in found[k].text for k in (101, 102))
    same = s.cleaned(documents([(k, "of " * 700) for k in range(3)])).collect()
    assert sorted(len(r.text.split()) for r in same)[:2] == [0, 0]
