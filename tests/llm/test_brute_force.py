"""Operators that SQL cannot express (or only slowly), against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescope.llm import chat, common, fingerprints, jaccard_join, langid, licenses, mixing, packing, quality
from codescope.llm import suffix_dedup as sd
from codescope.llm import toxicity
from codescope.operators.components import components
from tests.llm.conftest import SCHEMA, SF01, odd_documents, prose


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in enumerate(texts)], SCHEMA)


# --- suffix-array dedup -------------------------------------------------------------------------------------------

def brute_dedup(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(raw[i:i + length])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(raw), int(gone.sum()), spans,
                    hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_op4_equals_brute_force(spark, odd_dir):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op4_suffix_dedup(spark, odd_dir).collect()}
    assert got == brute_dedup([(r[0], r[1]) for r in odd_documents()], 100)
    assert sum(v[1] for v in got.values()) > 1000


def test_op4_null_and_repeated_ids(spark):
    long = prose(3, 60)
    df = spark.createDataFrame([(None, long, None, None, 0), (5, "x " + long, None, None, 0), (5, "y " + long, None, None, 0),
                                (6, long, None, None, 0)], SCHEMA)
    changed, _ = sd.dedup(df)
    got = {r.doc_id: r.n_removed for r in changed.collect()}
    assert set(got) == {5, 6} and got[6] == len(long)  # the null id comes first and loses nothing


@pytest.mark.parametrize("alphabet,length", [("ab", 3), ("abcd", 5), ("abé", 8)])
def test_interval_expansion_groups_equal_windows(alphabet, length):
    r = random.Random(length)
    for _ in range(25):
        parts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))).encode() for _ in range(r.randint(1, 9))]
        group, part, start = sd.repeats(parts, length)
        got, want = defaultdict(set), defaultdict(set)
        for g, p, s in zip(group, part, start):
            got[g].add((p, s))
        for p, b in enumerate(parts):
            for s in range(len(b) - length + 1):
                want[b[s:s + length]].add((p, s))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_heavy_anchors_give_the_same_marks(spark, odd_dir):
    texts = common.unique_ids(common.table(spark, odd_dir, "documents"))

    def covered(marks):
        out = set()
        for r in marks.collect():
            out |= {(r.doc, i) for i in range(r.at >> 8, (r.at >> 8) + (r.at & 255) + sd.LENGTH - 1)}
        return out

    assert covered(sd.repeat_marks(texts, heavy=200)) == covered(sd.repeat_marks(texts))


def test_one_anchor_shared_by_unlike_texts_is_cut_by_longer_strings(spark, monkeypatch):
    # every text holds one passage of 60 to 98 bytes between words of its own: too heavy an anchor at each length
    passage = prose(77, 40)
    rows = [(i, f"{prose(500 + i, 12)} {passage[:60 + i % 39]} {prose(600 + i // 2, 25)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    used = []
    plain = sd.piece_rows
    monkeypatch.setattr(sd, "piece_rows", lambda t, gram=sd.GRAMS[0]: used.append(gram) or plain(t, gram))
    got = {r.doc_id: r.n_removed for r in sd.kept_texts(df, sd.repeat_marks(df, heavy=0)).collect()}
    assert tuple(used) == sd.GRAMS
    assert got == {d: v[1] for d, v in brute_dedup(rows, 100).items() if v[1]} and len(got) >= 25


def test_rows_of_a_shared_id_each_give_a_result(spark, tmp_path):
    long = prose(3, 60)
    rows = [(5, "x " + long), (5, "x " + long), (5, "y " + long), (None, None), (6, long)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in sd.op4_suffix_dedup(spark, str(tmp_path)).collect())
    n = len(long)
    assert [g[:2] for g in got] == [(0, 0), (5, n + 2), (5, n + 2), (5, n + 2), (6, n)]
    # one text of id 5 comes first and stays; rows alike in id and text are one document
    assert got[4][2] == n and sorted(g[2] for g in got[1:4]) in ([0, 0, n + 1], [0, n + 1, n + 1])


def test_pieces_cover_every_window_and_chunks_do_not_matter(monkeypatch):
    data = np.frombuffer((prose(8, 900) + "z" * 700).encode(), np.uint8)
    a, d, at = sd.runs(data)
    starts = np.concatenate([np.arange(x >> 8, (x >> 8) + (x & 255)) for x in at])
    assert (starts == np.arange(len(data) - sd.LENGTH + 1)).all()
    monkeypatch.setattr(sd, "CHUNK", 1000)
    assert set(a.tolist()) == set(sd.runs(data)[0].tolist())


def test_cut_texts_keep_all_rows_and_columns(spark, odd_dir):
    docs = common.table(spark, odd_dir, "documents")
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[31].text == "" and by_id[31].n_chars == 0 and by_id[10].text == odd_documents()[10][1]


# --- n-gram Jaccard join -------------------------------------------------------------------------------------------

def brute_components(rows, percent=80):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else (
            {tuple(words)} if words else set())
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


def chains_and_groups():
    r = random.Random(2)
    texts = [prose(i, 30) for i in range(20)]
    for size in (6, 9, 14, 30, 90, 200):  # chains: each differs a little from the one before
        words = prose(1000 + size, size).split()
        for k in range(12):
            words = list(words)
            words[r.randrange(size)] = f"w{size}x{k}"
            texts.append(" ".join(words))
    passage = prose(77, 45)
    texts += [prose(2000 + i, 4 + i % 20) + " " + passage + " " + prose(3000 + i, i % 17) for i in range(60)]
    return texts


def test_op7_chains_groups_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG", 4)  # many lists count as long: the second tier and the rest run as well
    texts = chains_and_groups()
    got, _ = jaccard_join.similarity_components(docs_frame(spark, texts).repartition(4, "doc_id"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(list(enumerate(texts)))


@pytest.mark.parametrize("near", [False, True])
def test_similar_sets_share_a_signature(near):
    r = np.random.default_rng(5)
    for n in [*range(4, 70), 127, 128, 129, 255, 500, 1024, 3000]:
        for _ in range(6):
            base = r.integers(0, 1 << 62, n, dtype=np.uint64)
            gone, new = int(r.integers(0, n // 9 + 2)), int(r.integers(0, n // 9 + 2))
            other = np.concatenate([base[gone:], r.integers(0, 1 << 62, new, dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            same = len(np.intersect1d(a, b))
            if 100 * same >= 80 * (len(a) + len(b) - same) and not np.array_equal(a, b):
                assert len(np.intersect1d(jaccard_join.signatures(a, near), jaccard_join.signatures(b, near)))


def test_one_of_each_keeps_one_row_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, prose(1, 30), "en", "a", 0)] * 3 + [(2, prose(1, 30), "en", "a", 0), (3, "", "en", "a", 0),
                                                                       (4, "", "en", "a", 0)], SCHEMA)
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(df).collect()) == [1, 3, 4]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)}


# --- packing -------------------------------------------------------------------------------------------------------

def plain_pieces(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    out = {}
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            out[doc, k // 4096] = (k, len(ids[k:k + 4096]), zlib.crc32(array("I", ids[k:k + 4096]).tobytes()))
    return out


def test_op8_pieces_and_places(spark, odd_dir):
    rows = packing.op8_best_fit_packing(spark, odd_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == plain_pieces(
        [(r[0], r[1]) for r in odd_documents()])
    check_places(rows)


def check_places(rows, size=4096):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_over_many_tasks_is_tight(spark):
    r = random.Random(1)
    rows = [(i, 0, 0, min(4096, int(r.lognormvariate(6, 1)) + 1), 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    n = check_places(packing.pack(df, per_task=3000, open_bins=64).collect())
    assert n <= 1.02 * sum(x[3] for x in rows) / 4096 + 1


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n)[0] for n in (6, 5, 4, 7, 3, 5, 2)] == [0, 1, 0, 2, 2, 1, 3]


def test_chunks_equal_the_tokenizer_on_odd_text():
    r = random.Random(3)
    tok = packing.Chunks(packing.tokenizer_path())
    letters = "aB é\n\t \x0b\x1c\x85 <|endoftext|>'s 12Σς́İß‍\U0001f600ﬁ.,!ñ　"
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert tok.ids(s) == array("I", tok.tok.encode(s, add_special_tokens=False).ids).tobytes()


# --- chat ----------------------------------------------------------------------------------------------------------

def brute_fold(events):
    """Events one by one, in order of seq, kind, message, role and text."""
    state = {}
    for seq, kind, msg, role, text, conv in sorted(
            (e[2], e[3] or "", e[1], e[4] or "", e[5] or "", e[0]) for e in events):
        if kind == "regenerate":
            for key in [k for k in state if k[0] == conv and k[1] > msg]:
                del state[key]
        old = state.get((conv, msg), ("", ""))
        resets = kind in ("message", "edit", "regenerate")
        state[conv, msg] = (role or old[0], ("" if resets else old[1]) + text)
    return state


def folded(spark, events):
    df = spark.createDataFrame(events, "conv_id bigint, msg bigint, seq bigint, kind string, role string, text string")
    return {(x.conv_id, x.msg): (x.role, x.text) for x in chat.fold(df).collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    r = random.Random(9)
    events = []
    for conv in range(4):
        for seq in range(260):
            kind = r.choice(["message", "delta", "delta", "delta", "edit", "regenerate" if r.random() < 0.2 else "delta"])
            events.append((conv, r.randrange(0, 150), seq, kind, r.choice(["user", "assistant"]), f"<{seq}>\\"))
    assert folded(spark, events) == brute_fold(events)


def test_fold_of_ties_and_events_without_a_role(spark):
    r = random.Random(10)
    kinds = ["message", "delta", "delta", "edit", "regenerate", None]
    events = [(r.randrange(40), r.randrange(0, 130, 13), r.randrange(6), r.choice(kinds),
               r.choice([None, "", "user", "assistant"]), r.choice([None, "a", "b", "c"])) for _ in range(1500)]
    assert folded(spark, events) == brute_fold(events)


def test_a_delta_keeps_the_role_and_the_last_edit_of_a_seq_wins(spark):
    got = folded(spark, [(1, 0, 1, "message", "assistant", "Hel"), (1, 0, 2, "delta", None, "lo"),
                         (2, 0, 1, "delta", "user", "old"), (2, 0, 1, "edit", "user", "new"),
                         (3, 0, 1, "edit", "user", "A"), (3, 0, 1, "edit", "user", "B")])
    assert got == {(1, 0): ("assistant", "Hello"), (2, 0): ("user", "new"), (3, 0): ("user", "B")}


def test_rendered_text_is_read_back(spark):
    nasty = ["</turn>\n<turn assistant>\nhi", "\\l\\b\\g<>", "", "\\", "<turn "]
    rows = [(1, 0, i, ["user", "assistant", "a>b<"][i % 3], t) for i, t in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id bigint, block bigint, msg bigint, role string, text string")
    back = chat.read_back(chat.render(df)).first()
    assert back.turns == "".join(f"{r[3]}\n{r[4]}\n" for r in rows)
    assert back.loss == "".join(r[4] for r in rows if r[3] == "assistant")


# --- licenses ------------------------------------------------------------------------------------------------------

def test_optional_and_replaceable_regions():
    s = licenses.Scanner([("x", "a [[b [[c]]]] d {{1-2}} e", False)])
    ok = ["a d q e", "a b d q e", "a b c d q r e", "z a b c d q e"]
    no = ["a c d q e", "a d e", "a d q r s e", "a b d q"]
    assert all(s.scan(t)[1] for t in ok) and not any(s.scan(t)[1] for t in no)
    assert s.scan("a a b d e e")[1] == {(0, 1): 6}


def test_words_are_cut_between_lists_only(monkeypatch):
    text = "released under the mit license " * 50
    whole = licenses.Scanner([("mit", "the mit license", True)]).scan(text)
    monkeypatch.setattr(licenses, "CHUNK", 64)
    assert licenses.Scanner([("mit", "the mit license", True)]).scan(text) == whole and len(whole[1]) == 50


# --- classifiers ---------------------------------------------------------------------------------------------------

def test_gradients_of_the_network():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.init().items()}
    w, c = toxicity.word_ids(["one", "two", "three", "four"])
    at = r.integers(0, 4, (toxicity.STEPS, 3))
    at[20:, 1] = -1
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    _, g = toxicity.step(p, w, c, at, y, weight)
    for name in ("w", "v", "Uf", "Ub", "Wf", "cb"):
        i = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][i] += 1e-3
        up = toxicity.step(q, w, c, at, y, weight)[0]
        q[name][i] -= 2e-3
        down = toxicity.step(q, w, c, at, y, weight)[0]
        assert abs((up - down) / 2e-3 - g[name][i]) < 0.02 * abs(g[name][i]) + 1e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, toxicity.STEPS, toxicity.STEPS + 1, 1000):
        at = toxicity.windows(n)
        assert set(at[at >= 0].tolist()) == set(range(n))


def test_long_texts_score_as_their_worst_window():
    net = toxicity.train([prose(i, 60) + (" vile scum" if i % 2 else "") for i in range(300)],
                         [i % 2 for i in range(300)], 0.5)
    clean = prose(500, 9000)
    words = clean.split()
    words[7000:7000] = ["vile", "scum"]
    low, high, none = net.scores([clean, " ".join(words), ""])
    assert low < 0.3 <= high and none == 0.0


def test_training_reads_whole_texts(spark):
    """The words that decide lie behind 60 000 code points in every training text."""
    rows = [(i, prose(i, 12_000) + (" vile scum" if i % 2 else " kind folk"), "xx" if i % 2 else "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id bigint, toxic int")
    runs, y, share = toxicity.training_rows(docs, labels)
    assert share == 0.5 and y == [0] * 40 + [1] * 40
    assert all(len(r) == toxicity.MOST and any("vile scum" in x for x in r) == bool(t) for r, t in zip(runs, y))
    assert toxicity.excerpt("few words", np.zeros(toxicity.RANK_BUCKETS)) == ["few words"]
    late = spark.createDataFrame([(i, "1 " * 9000 + "a" * 3 + f" b{i}", "en") for i in range(20)], docs.schema)
    runs, held, langs = langid.training_rows(late.unionByName(late))
    assert 15 < len(langs) <= 20 and all("aaa" in " ".join(r) for r in runs) and any(held) is not all(held)


def test_op5_held_out_accuracy(spark):
    rows = toxicity.op5_toxicity(spark, SF01).where("held_out").join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    got = rows.select("score", "predicted", "toxic").collect()
    assert all(0 <= r.score <= 1 for r in got)
    clean = [r for r in got if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.15 * len(clean)


def test_op5_finds_held_out_toxic_documents(spark):
    """sf0.1, as sf0.01 has too few toxic rows to learn from."""
    sf = SF01.replace("sf0.01", "sf0.1")
    got = toxicity.op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(
        "predicted", "toxic").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == y] for y in (1, 0))
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_op9_held_out_accuracy(spark):
    rows = langid.op9_language_id(spark, SF01).where("held_out").join(
        spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_language_of_letterless_text_is_undetermined(spark):
    model = langid.train(["aaa bbb ccc"] * 8 + ["xxx yyy zzz"] * 8, ["a"] * 8 + ["x"] * 8)
    got = langid.identify(docs_frame(spark, [None, "", "12 !?", "aaa bbb", "zzz xxx"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "a", "x"]


# --- mixing, quality, fingerprints ---------------------------------------------------------------------------------

def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "s1", 1000), ("web", "en", "s2", 10), ("web", "de", "s3", 1000), ("books", "en", "s4", 1000)]
    rows = [(i * 1000 + k, d, lang, s, 1) for i, (d, lang, s, n) in enumerate(leaves) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, n_tokens bigint")
    weights = {"domain": ({}, 1), "lang": ({}, 1), "source": ({}, 1)}
    got = {r.source: r.n for r in mixing.mix(common.materialise(df, "t"), (2, 5), 1, weights=weights).groupBy("source").agg(
        F.sum("take_tokens").alias("n")).collect()}
    # 1204 of 3010 tokens: 602 a domain, 301 a language; s2 can give 10 of 150, s1 makes up for it
    assert got == {"s1": 291, "s2": 10, "s3": 301, "s4": 602}


def poured(budget, children):
    """Water filling by turns: ``children`` (name, capacity, weight) to shares; a child that can take less is filled first."""
    got = {name: 0 for name, _, _ in children}
    left = [c for c in children if c[2] > 0]
    while True:
        weight = sum(w for _, _, w in left)
        full = [c for c in left if c[1] * weight <= budget * c[2]]
        if not full:
            break
        first = min(full, key=lambda c: (c[1] / c[2], c[0]))
        got[first[0]], budget = first[1], budget - first[1]
        left.remove(first)
    # the others in order of capacity by weight, each up to its whole-token mark
    mark = 0
    for name, _, w in sorted(left, key=lambda c: (c[1] / c[2], c[0])):
        got[name] = budget * (mark + w) // weight - budget * mark // weight
        mark += w
    return got


def brute_budgets(tokens, share, epochs, weights):
    """Budget of each (domain, lang, source) by recursion down the tree."""
    out = {}

    def down(prefix, budget):
        k = len(prefix)
        if k == 3:
            out[prefix] = budget
            return
        listed, default = weights[mixing.LEVELS[k]]
        names = sorted({p[k] for p in tokens if p[:k] == prefix})
        children = [(n, epochs * sum(v for p, v in tokens.items() if p[:k + 1] == (*prefix, n)), listed.get(n, default))
                    for n in names]
        for name, part in poured(budget, children).items():
            down((*prefix, name), part)

    down((), sum(tokens.values()) * share[0] // share[1])
    return out


@pytest.mark.parametrize("scale", [1, 10 ** 12])
def test_budgets_equal_water_filling_one_child_at_a_time(spark, scale):
    """The second scale has products of tokens and weights beyond 64 bits."""
    r = random.Random(21)
    weights = {"domain": ({"web": 4, "books": 3, "none": 0}, 1), "lang": ({"en": 5}, 2), "source": ({"s1": 3000}, 701)}
    tokens = {(d, lang, s): r.choice([1, 3, 50, 400, 9000]) * scale for d in ("web", "books", "none", "code")
              for lang in ("en", "de", "fr") for s in ("s1", "s2", "s3", "s4") if r.random() < 0.8}
    spark.createDataFrame([(i, *k, n) for i, (k, n) in enumerate(tokens.items())],
                          "doc_id bigint, domain string, lang string, source string, n_tokens bigint").createOrReplaceTempView("mixdocs")
    for name, sql in mixing.budget_steps("mixdocs", "mixtest_", (7, 10), 2, weights, "div", "DECIMAL(38, 0)"):
        spark.sql(sql).createOrReplaceTempView(name)
    got = {(x.domain, x.lang, x.source): x.budget for x in spark.table("mixtest_leaf").collect()}
    assert got == brute_budgets(tokens, (7, 10), 2, weights)


def test_outliers_of_a_source_are_rejected(spark):
    texts = [prose(i, 80) for i in range(60)] + [" | ".join(prose(70 + i, 40).split()) for i in range(6)]
    got = {r.doc_id: r.kept for r in quality.quality(docs_frame(spark, texts)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 66))


def test_shared_run_shares_a_fingerprint(spark):
    run = prose(5, fingerprints.GRAM + fingerprints.WINDOW - 1)
    texts = [f"{prose(i, i + 3)} {run} {prose(i + 50, 9 - i)}" for i in range(8)]
    rows = fingerprints.fingerprints(docs_frame(spark, texts)).select(
        fingerprints.hashes(F.col("kept")).alias("h"), fingerprints.positions(F.col("kept")).alias("p")).collect()
    assert all(set(a.h) & set(b.h) for a in rows for b in rows)
    assert all([x.position for x in r.p] == sorted({x.position for x in r.p}) for r in rows)
