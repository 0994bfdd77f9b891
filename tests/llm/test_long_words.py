"""Words are scored over all their bytes, and long unspaced runs to their end."""

import random

import numpy as np

from codescope.llm import common, langid, toxicity
from tests.llm.conftest import prose


def glyphs(seed, n, first=0x4E00, kinds=200):
    r = random.Random(seed)
    return "".join(chr(first + r.randrange(kinds)) for _ in range(n))


def test_pieces_cover_a_run_and_share_letters():
    for first, size, shared in ((0x4E00, common.WIDE_LONGEST, common.WIDE_SHARED), (0x430, common.LONGEST, common.SHARED)):
        for n in range(size + 1, 100):
            w = "".join(chr(first + i % 30) for i in range(n))
            parts = common.words_of(f"a {w}, b")
            assert parts[0] == "a" and parts[-1] == "b" and max(map(len, parts)) <= size
            assert parts[1] + "".join(p[shared:] for p in parts[2:-1]) == w
        assert common.words_of(w[:size]) == [w[:size]]


def test_words_that_share_their_first_bytes_differ():
    head = "при" * 5
    words = [head + "ятель", head + "знак"]
    f = langid.features(words)
    assert f[0, 0] != f[1, 0] and set(f[0]) != set(f[1])
    w, c = toxicity.word_ids(words)
    assert w[0] != w[1] and set(c[0]) != set(c[1])


def test_a_long_neighbour_does_not_change_a_word():
    alone, beside = langid.features(["word"]), langid.features(["word", "ы" * 22])
    assert set(alone[0]) == set(beside[0]) and alone[0, 0] == beside[0, 0]
    words = [f"w{'abcdefghij'[i % 10]}" * 2 for i in range(10)] + ["語" * 22]
    both, one = toxicity.spellings(words), toxicity.word_ids(words[:10])
    assert (both[0][:10] == one[0]).all() and [set(x) for x in both[1][:10]] == [set(x) | {-1} for x in one[1]]


def test_toxic_end_of_an_unspaced_run_decides():
    bad = "惡毒卑鄙渣滓"
    net = toxicity.train([glyphs(i, 60) + (bad if i % 2 else glyphs(i, 6)) + glyphs(9000 + i, 9) for i in range(600)],
                         [i % 2 for i in range(600)], 0.5)
    clean = [glyphs(20_000 + i, 60) for i in range(40)]
    low = np.array(net.scores([c + glyphs(i, 6) + glyphs(99, 9) for i, c in enumerate(clean)]))
    high = np.array(net.scores([c + bad + glyphs(99, 9) for c in clean]))
    assert (high > low).mean() >= 0.9 and high.mean() > low.mean() + 0.3, (low.mean(), high.mean())


def test_language_of_a_long_run_is_that_of_most_of_it():
    model = langid.train([glyphs(i, 60, 0x4E00) for i in range(30)] + [glyphs(i, 60, 0x3041, 80) for i in range(30)],
                         ["zh"] * 30 + ["ja"] * 30)
    run = glyphs(77, 8) + glyphs(78, 200, 0x3041, 80)
    assert model.predict(run)[0] == "ja" and model.predict(glyphs(79, 200))[0] == "zh"


def test_plain_words_score_as_before():
    words = prose(3, 50).split()
    m = common.byte_matrix(words, 24)
    h = np.zeros(len(m), np.uint32)
    for j in range(24):
        h = h * np.uint32(31) + m[:, j]
    assert m.shape[1] == 24 and (common.byte_hash(m, 24) == h).all()


def test_op7_parities_never_overstate_a_difference():
    from codescope.llm import jaccard_join as jj
    r = np.random.default_rng(1)
    new = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    sets, pairs = [np.zeros(0, np.uint64)], []
    for n in (1, 3, 40, 200, 900, 5000, 20000):
        a = np.unique(new(n))
        for other in (0, n // 20, n // 4, n, 3 * n):
            pairs.append((len(sets), len(sets) + 1))
            sets += [a, np.unique(np.concatenate([a[other // 2:], new(other)]))]
    x, y = (np.array(z) for z in zip(*pairs, (0, 1)))
    least = jj.apart([jj.parities(s) for s in sets], x, y)
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (least <= real).all() and (least >= 0).all()
    near = (real < 0.4 * np.array([len(sets[i]) for i in x])) & (real > 0)
    assert near.sum() >= 8 and (least[near] >= 0.75 * real[near]).all()  # and it says much about sets that are near
