"""The parts without Spark, against brute force."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchweave.llm import bpe, html_extract, langid, license_scan, packing, quality
from sketchweave.llm.interval_expansion import classes
from sketchweave.llm.jaccard_join import open_block, shingle_sets
from sketchweave.llm.queries import tokenizer_file
from sketchweave.llm.vector_dedup import centroids_of, prune

TEXTS = ["Don't they'LL we've 's ''s !!'s x's3 a1b2 12 34", "İstanbul naïve é ́abc", "<|endoftext|> a<|ENDOFTEXT|>b", "日本語 テスト ½ ª x \x0b\x0c z", "", "   ", None, "a" * 100 + " " + "ß" * 70, "it's 'tis rock'n'roll $$$*** — “quote” …", "Thntblere of then, edtioner in inea that esly."]


@given(st.integers(1, 8), st.lists(st.text("ab", min_size=1, max_size=25), min_size=1, max_size=10))
@settings(max_examples=150, deadline=None)
def test_interval_expansion(least, strings):
    raw = np.frombuffer("".join(strings).encode(), np.uint8)
    got, want, at = classes(raw, np.array([len(s) for s in strings]), least), {}, 0
    for s in strings:
        for i in range(len(s)):
            if len(s) - i < least:
                assert got[at] == -1
            else:
                assert want.setdefault(s[i : i + least], got[at]) == got[at]
            at += 1
    assert len(set(want.values())) == len(want)


def test_bpe_gives_the_ids_of_the_library():
    coder = bpe.load(tokenizer_file())
    ids, counts = coder.encode(pa.array(TEXTS))
    ends = np.cumsum(counts)
    for text, a, b in zip(TEXTS, ends - counts, ends):
        assert ids[a:b].tolist() == coder.library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.integers(1, 9000), max_size=80), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_packing_holds_limits_and_loses_nothing(lengths, segments):
    n = np.array(lengths, np.int64)
    seen = [[] for _ in lengths]
    for seq in packing.pack_lengths(n, 2048, segments):
        assert sum(k for _, _, k in seq) <= 2048 and len(seq) <= segments
        for i, start, k in seq:
            seen[i].append((start, k))
    for i, parts in enumerate(seen):
        at = 0
        for start, k in sorted(parts):
            assert start == at and k > 0
            at += k
        assert at == lengths[i]


def test_packing_leaves_no_padding_with_free_cuts():
    n = np.random.default_rng(0).lognormal(6.5, 1.2, 3000).astype(int) + 1
    fill = [sum(k for _, _, k in s) for s in packing.pack_lengths(n, 2048, 512)]
    assert all(f == 2048 or f & (f - 1) == 0 for f in fill)


def test_vector_packing_without_cuts():
    sizes = np.random.default_rng(1).integers(1, 900, (500, 3))
    sizes[:, 1], sizes[:, 2] = 1, np.minimum(sizes[:, 2], sizes[:, 0])
    limits = np.array([2048, 16, 1000])
    bins = packing.fill_bins(sizes, limits, cut=False)
    assert sorted(i for b in bins for i, _, _ in b) == list(range(500))
    assert all((sizes[[i for i, _, _ in b]].sum(axis=0) <= limits).all() for b in bins)
    assert len(bins) <= 1.25 * max(-(-sizes.sum(axis=0) // limits))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_shingle_sets():
    texts = ["A b c d e", "a B c d e a b c d", "one two", "", None, " \t ", "x y z É é", "end", "w " * 50]
    sets = dict(shingle_sets(pa.array(texts), 4))
    for i, t in enumerate(texts):
        w = words_of(t)
        want = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        assert len(sets[i]) == len(want)
    assert len(np.intersect1d(sets[0], sets[1])) == 2


def test_open_block_links():
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    rows = [(i, np.unique(np.where(rng.random(100) < 0.06, rng.integers(1000, 10**6, 100).astype(np.uint64), base))) for i in range(30)]
    parent = list(range(30))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, x in rows:
        for b, y in rows:
            if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
                parent[root(a)] = root(b)
    want = {frozenset(j for j in range(30) if root(j) == root(i)) for i in range(30)}
    parent = list(range(30))
    for a, b in open_block(rows, rows, 85):
        parent[root(a)] = root(b)
    assert want == {frozenset(j for j in range(30) if root(j) == root(i)) for i in range(30)}


@pytest.fixture(scope="module")
def language_model():
    return langid.fit([("en", "the cat and the other hat of theirs " + "thecat" * 20), ("de", "der hund und die katze mit dem hut " + "derhund" * 30)] * 5, tokenizer_file("piece_bpe_32k.model"))


def forward_brute(model, word):
    """Logarithm of the sum over all segmentations, and the prefix sums, with exact integers as exponents."""
    place = {p: i for i, p in enumerate(model.pieces)}
    a = [np.longdouble(1)] + [np.longdouble(0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in place:
                a[j] += a[i] * np.longdouble(model.probs[place[word[i:j]], 0])
    return np.log(np.array(a))


def test_forward_sums_all_segmentations(language_model):
    model = language_model
    assert any(len(p) > 16 for p in model.pieces) and any(b" " in p[1:] for p in model.pieces)
    words = [b" the", b" thehatmitderkatze" * 3, " представ".encode(), " становника".encode() * 4, b" x" + b"theirs" * 40, b" y" + b"und" * 90]
    for word in words:
        want = forward_brute(model, word.replace(b" ", b"q", 0))
        letters = np.frombuffer(word, np.uint8)[None, :]
        assert langid.forward(model.find().spans(letters), len(word), model.probs)[0, 0] == pytest.approx(float(want[-1]), rel=1e-9)
    arrays = [np.frombuffer(w, np.uint8) for w in words]
    for word, got, prefixes in zip(words, langid.forward_long(model.find(), arrays, model.probs), langid.forward_long(model.find(), arrays, model.probs, keep=True)):
        want = forward_brute(model, word)
        assert got[0] == pytest.approx(float(want[-1]), rel=1e-9)
        assert prefixes[:, 0] == pytest.approx(want.astype(float), rel=1e-9, abs=1e-9)
    best, score = model.score(pa.array(["the other cat", "die katze", "", None, "123 !!"]))
    assert best.tolist()[:1] == [1] and best.tolist()[1:] == [0, -1, -1, -1] and (score[2:] == 0).all()


def test_expected_counts_of_long_words_are_those_of_short_ones(language_model):
    find, probs = language_model.find(), language_model.probs
    word = np.frombuffer(b" " + b"thehatundtheirkatze" * 4, np.uint8)
    one, two = np.zeros_like(probs), np.zeros_like(probs)
    langid.expected(find.spans(word[None, :]), len(word), probs, np.array([[2.0, 3.0]]), one)
    langid.expected_long(find, word, probs, np.array([2.0, 3.0]), two)
    assert np.allclose(one[:-1], two[:-1], rtol=1e-8, atol=1e-12)


def test_a_very_long_run_takes_seconds(language_model):
    begin = time.monotonic()
    best, score = language_model.score(pa.array(["the cat " + "undderhund" * 100_000, "cat"]))
    assert best.tolist() == [0, 1] and time.monotonic() - begin < 40


def test_quality_model_votes():
    good, bad = "a plain line of prose with many words ", "BUY!! NOW!! $$$ "
    model = quality.fit(pa.array([good * (i + 1) for i in range(20)] + [bad * (i + 1) for i in range(20)]), np.array([1] * 20 + [0] * 20))
    score = model.score(pa.array([good * 7, bad * 7, "", None]))
    assert score[0] > 0.9 and score[1] < 0.1 and score[2] == score[3] == 0.5
    assert quality.fit(pa.array([], pa.string()), np.zeros(0)) is None


@pytest.fixture(scope="module")
def licences():
    return license_scan.fit(["The cat sat on the mat with a hat.", "Und der Hund lief.", "It was a long day for all of them."] * 50)


@pytest.mark.parametrize("text,family", [("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("All rights reserved.", "all-rights-reserved"), ("licensed under the apache license version 2.0", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Licensed under the Zeta Community License.", None), ("The dog ran over the mat.", None)])
def test_licence_families(licences, text, family):
    raw = np.frombuffer(text.encode(), np.uint8)
    *_, hashes, counts = license_scan.paragraphs(raw, np.array([0, len(raw)]))
    p = licences.probabilities(hashes, counts)[0]
    best = int(p[: license_scan.NONE].argmax())
    sure = p[license_scan.NONE] < 0.5 and p[best] >= licences.threshold and licences.similarity(best, license_scan.gram_set(hashes)) >= license_scan.CONFIRM
    assert (license_scan.FAMILIES[best] if sure else None) == family


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<!-- x", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>unclosed <b>x", "unclosed x"),
        ("a < b and <3", "a < b and <3"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One,  two\nthree.<br>four</article><footer>&copy;</footer>", "T\nOne, two three. four"),
        ("<script>var t='</p>';</script><style>p{}</style><main><p>Text, with words. And more, yes.</p><form><p>Name, please.</p></form></main>", "Text, with words. And more, yes."),
        ("<div class='sidebar'><p>Links, all of them, here.</p></div><div id=c><p>Body text, first. It goes on, and on.</p><p>Second, part.</p><div class='comments'><p>Nice, one. I agree.</p></div></div>", "Body text, first. It goes on, and on.\nSecond, part."),
    ],
)
def test_html(page, text):
    assert html_extract.extract(page) == text


def test_html_with_unclosed_quotes_is_linear():
    assert isinstance(html_extract.extract("<a href='" + "x" * 200_000 + "<p " * 20_000), str)


def test_pruned_lists_reach_everything():
    x = np.random.default_rng(4).standard_normal((300, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = prune(x)
    assert len(lists) == 300 and all(0 < len(n) <= 16 and i not in n for i, n in enumerate(lists))
    assert centroids_of(x, 5).shape == (5, 8)
