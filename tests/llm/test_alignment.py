import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from attestra.llm import alignment
from attestra.llm.alignment import BYTE_LEVEL, PIECES, Sides, Transducer, alignments, groups

ODD = [
    None, "", " ", " a", "a ", "a  b", "a▁b", "<|endoftext|> x <s>", "\n", "\nx", "x\ny\n\nz", "tab\tq", "日本語 テキスト", "é é ﬁ", "a b", "a\r\nb", "x" * 3000, "🙂🙂 ok", "▁",
    "\x00a", "of the", "of the",
]


@pytest.fixture(scope="module")
def sides():
    return Sides(BYTE_LEVEL, PIECES)


def cut(sides, text):
    """Groups of a text by the offsets at which both sides end."""
    a, b = (sides.a.encode(" " + text, add_special_tokens=False).ids, sides.b.encode(text)) if text else ([], [])
    spelled = [b"".join(of[i] for i in ids) for of, ids in ((sides.a_bytes, a), (sides.b_bytes, b))]
    if not text or spelled != [(" " + text).encode()] * 2:
        return [], 0, 0
    ends = [list(accumulate(len(of[i]) for i in ids)) for of, ids in ((sides.a_bytes, a), (sides.b_bytes, b))]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_i, to_j = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((a[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    return out, len(a), len(b)


def by_hand(sides, texts):
    cuts = [cut(sides, t) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g, _, _ in cuts]
    counts = Counter(pair for some in links for pair in set(some))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    spelled = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for g, _, _ in cuts]
    return [
        (n_a, n_b, len(g), len(l), sum(counts[p] == most[p[0]] for p in l), sum(counts[p] for p in l), hashlib.sha256(s.encode()).hexdigest() if s else "")
        for (g, n_a, n_b), l, s in zip(cuts, links, spelled)
    ]


def test_transducer_closes_groups_where_both_sides_end():
    t = Transducer([b"ab", b"c", b"x"], [b"a", b"bc", b"abc", b"bd"])
    assert t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([0, 1, 0, 1], [2, 0, 1]) == ([2, 4], [1, 3])
    assert t.groups([0], [0]) is None and t.groups([0, 1], [0, 3]) is None and t.groups([2], [0]) is None
    assert t.groups([], []) == ([], []) and t.groups([0], []) is None


def test_transitions_are_remembered_and_forgotten():
    t = Transducer([b"ab", b"c"], [b"a", b"bc"], kept=3)
    assert t.groups([0, 1] * 50, [0, 1] * 50) == (list(range(2, 101, 2)),) * 2
    assert len(t.steps[0]) + len(t.steps[1]) == 4 and len(t.suffixes) == 4
    assert t.groups([0, 1], [0, 1]) == ([2], [2])  # starts from nothing


@pytest.mark.parametrize("block_pairs", [1 << 21, 300])
def test_counts_and_groups_equal_brute_force(spark, corpus, sides, block_pairs):
    texts = [t for _, t, *_ in corpus] + ODD
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in alignments(df, block_pairs=block_pairs).collect()}
    assert got == dict(enumerate(by_hand(sides, texts)))


def test_repeated_rows_count_as_often_as_they_occur(spark, sides):
    texts = ["same words here"] * 40 + ["same words", "other here"]
    df = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(tuple(r[1:]) for r in alignments(df).collect()) == sorted(by_hand(sides, texts))


def test_empty_table(spark, empty):
    out = alignments(empty)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0


def test_stretches_beyond_what_a_worker_keeps(sides, monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeé▁<") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    reader = alignment.Aligner(BYTE_LEVEL, PIECES, kept=2_000)
    for at in range(0, 20, 4):
        table, items, order = reader.of_texts(pa.array(texts[at : at + 4]))
        assert alignment._sums(table.sizes[order], items)[:, :3].tolist() == [[n_a, n_b, len(g)] for g, n_a, n_b in (cut(sides, t) for t in texts[at : at + 4])]


def test_groups_with_offsets(spark, sides):
    out = {r["doc_id"]: r["groups"] for r in groups(spark.createDataFrame([(1, "bytes of words"), (2, None), (3, "▁")], "doc_id long, text string")).collect()}
    assert out[2] == out[3] == []
    assert [(g["a_ids"], g["b_ids"]) for g in out[1]] == cut(sides, "bytes of words")[0]
    assert out[1][0]["start"] == 0 and out[1][-1]["end"] == len(" bytes of words") and all(x["end"] == y["start"] for x, y in zip(out[1], out[1][1:]))
