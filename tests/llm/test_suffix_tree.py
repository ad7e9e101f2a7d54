import math
from collections import Counter

import numpy as np

from tests.llm.data import ODD, corpus, remainder, row, table
from webcorpus.llm import suffix_tree


def words(text):
    return (text or "").encode().translate(suffix_tree.LOWER).split() + [b""]


def test_base_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD", 20)
    rows = corpus(100) + ODD
    counts = Counter()
    for r in rows:
        if remainder(r[0], 10) not in (None, 0):
            counts.update(words(r[1]))
    n, v = sum(counts.values()), len(counts)
    found = suffix_tree.op4(table(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = []
    for r in rows:
        own = words(r[1])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        expected.append((str(r[0]), remainder(r[0], 10) == 0, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got) == sorted(expected)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def edges_of(texts, depth, least):
    """Candidates counted the plain way."""
    counts = [Counter() for _ in range(depth + 1)]
    for text in texts:
        stream = b"\n" * depth + text + b"\n"
        for k in range(depth, len(stream)):
            for level in range(depth + 1):
                counts[level][stream[k - level : k], stream[k]] += 1
    total = sum(counts[0].values())
    levels = []
    for level in range(depth + 1):
        sums = Counter()
        for (context, _), n in counts[level].items():
            sums[context] += n
        kept = [(int.from_bytes(c, "big"), s, n) for (c, s), n in counts[level].items() if sums[c] >= least * total]
        levels.append(tuple(np.array(x, np.int64) for x in zip(*sorted(kept))) if kept else tuple(np.zeros(0, np.int64) for _ in range(3)))
    return levels


def test_candidates_match_plain_counts(spark):
    rows = corpus(30) + [r for r in ODD if r[1] is None or len(r[1]) < 1000]
    texts = [b" ".join(words(r[1])[:-1]) for r in rows]
    counts = suffix_tree.corpus_counts(table(spark, rows), 3)
    found = sorted((r.level, r.context, r.symbol, r.n) for r in suffix_tree.candidates(counts, 3, 0.002).collect())
    expected = sorted((k, *map(int, e)) for k, level in enumerate(edges_of(texts, 3, 0.002)) for e in zip(*level))
    assert found == expected


def naive_score(tree_edges, text, depth, gain, back_off):
    """Longest retained suffix looked up by hand, with the same smoothing."""
    whole = np.zeros(256)
    np.add.at(whole, tree_edges[0][1], tree_edges[0][2])
    usual = [s for s in range(256) if whole[s] >= max(1.0, whole.sum() * 1e-6)]
    group = {s: k for k, s in enumerate(usual)}
    width, rare = len(usual) + 1, 256 - len(usual)
    uniform = np.array([1.0] * len(usual) + [rare])
    uniform /= uniform.sum()
    smooth = {}
    for level, (context, symbol, n) in enumerate(tree_edges):
        own = {0: np.zeros(width)} if level == 0 else {}
        for c, s, k in zip(context.tolist(), symbol.tolist(), n.tolist()):
            own.setdefault(c, np.zeros(width))[group.get(s, width - 1)] += k
        for c, counts in own.items():
            parent = uniform if level == 0 else smooth[level - 1, c & ((1 << 8 * (level - 1)) - 1)]
            p = (counts + back_off * parent) / (counts.sum() + back_off)
            seen = counts > 0
            nats = (counts[seen] * np.log(counts[seen] / counts.sum() / parent[seen])).sum()
            smooth[level, c] = p if level == 0 or nats > gain * max(1, seen.sum()) else parent
    stream, total = b"\n" * depth + text + b"\n", 0.0
    for k in range(depth, len(stream)):
        level = next(j for j in range(depth, -1, -1) if (j, int.from_bytes(stream[k - j : k], "big")) in smooth)
        p = smooth[level, int.from_bytes(stream[k - level : k], "big")]
        g = group.get(stream[k], width - 1)
        total += math.log10(p[g] / (rare if g == width - 1 else 1))
    return total


def test_walk_finds_the_longest_suffix():
    texts = [b" ".join(words(r[1])[:-1]) for r in corpus(40)]
    edges = edges_of(texts, 3, 0.001)
    tree = suffix_tree.grow(edges, 3, 1.0, 10.0)
    ask = texts[:5] + [b"", b"zq \xff\xfe unseen", b"a" * 3000]
    together = tree.walk(ask)
    for text, score in zip(ask, together):
        assert abs(tree.walk([text])[0] - score) < 1e-6
        assert abs(naive_score(edges, text, 3, 1.0, 10.0) - score) < 1e-3 * max(1, len(text) / 100)


def test_probabilities_of_every_state_sum_to_one():
    edges = edges_of([b" ".join(words(r[1])[:-1]) for r in corpus(40)], 3, 0.001)
    tree = suffix_tree.grow(edges, 3)
    members = np.bincount(tree.group, minlength=tree.gain.shape[1])
    assert np.allclose((10 ** tree.gain.astype(float) * members).sum(axis=1), 1, atol=1e-5)


def test_learned_text_is_likelier_than_noise(spark):
    noise = next(i for i in range(5000, 6000) if remainder(i, 10) == 0)
    rows = corpus(120) + [row(noise, "xqzj kvwp " * 40)]
    sizes = {r[0]: len(r[1].encode()) for r in rows}
    found = {r.doc_id: r.score / sizes[r.doc_id] for r in suffix_tree.op4(table(spark, rows)).collect()}
    assert all(found[noise] < found[i] for i in range(120))


def test_tables_without_training_texts(spark):
    assert suffix_tree.op4(table(spark, [])).collect() == []
    held = next(i for i in range(100) if remainder(i, 10) == 0)
    (only,) = suffix_tree.op4(table(spark, [row(held, "ab c")])).collect()
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0)
    assert only.base_score == 0 and abs(only.score - 5 * math.log10(1 / 256)) < 1e-3


def test_tables_score_like_the_tree_in_memory(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "HEAD_WINDOWS", 50)
    rows = corpus(60) + [r for r in ODD if r[1] is None or len(r[1]) < 1000]
    texts = [b" ".join(words(r[1])[:-1]) for r in rows]
    edges = edges_of([t for r, t in zip(rows, texts) if remainder(r[0], 10) not in (None, 0)], 5, 0)
    levels = []
    for context, symbol, n in edges:
        totals = Counter()
        for c, k in zip(context.tolist(), n.tolist()):
            totals[c] += k
        often = np.array([totals[c] >= suffix_tree.LEAST for c in context.tolist()], bool)
        levels.append((context[often], symbol[often], n[often]))
    expected = suffix_tree.grow(levels, 5).walk(texts)
    found = suffix_tree.op4(table(spark, rows)).collect()
    assert len(found) == len(rows)
    got = sorted((str(r.doc_id), round(r.score, 2)) for r in found)
    for (a, x), (b, y) in zip(got, sorted((str(r[0]), e) for r, e in zip(rows, expected))):
        assert a == b and abs(x - y) < 0.02


def test_contexts_seen_twice_are_learned_at_any_size(spark):
    """A rare language's context stays a candidate however many other positions there are."""
    grams = [(None, int.from_bytes(b"abcdez", "big"), 2), (None, int.from_bytes(b"     q", "big"), 10**9)]
    counts = spark.createDataFrame(grams, "word binary, gram bigint, n bigint")
    levels = suffix_tree.learned(counts)
    rare = int.from_bytes(b"abcde", "big")
    assert [(r.context, r.symbol, r.n) for r in levels[5].filter(f"context = {rare}").collect()] == [(rare, ord("z"), 2)]
    (chance,) = suffix_tree.chances(counts.select("gram").filter(f"gram = {grams[0][1]}"), levels).collect()
    assert chance.log > math.log10(1e-6)
