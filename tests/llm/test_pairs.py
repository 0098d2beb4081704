"""Operators 11 to 13 against brute force: token alignment, near vectors, conversation repair."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import align, ego, repair

TEXTS = [
    "The quick brown fox, isn't it?", "  two  spaces at  both ends  ", "a\n b\r\n\n  c\t d", "é" * 12 + " \U0001f600 naïve 日本語のテキスト", "<s> </s> <|endoftext|> plain",
    "a ▁ lower one of the pieces", "x", " ", "\n", "nul\0inside", None, "", "the the the cat", "The quick brown fox, isn't it?", "many words " * 4_000,
]


def token_sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    code = align.byte_level()
    bytes_a = lambda i: bytes(code[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    return a, b, bytes_a, bytes_b


def spans(tokens):
    at, found = 0, []
    for t in tokens:
        found.append((at, at + len(t)))
        at += len(t)
    return found


def alignment_by_hand(texts):
    a, b, bytes_a, bytes_b = token_sides()
    found, count = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, ids_a)) != raw or b"".join(map(bytes_b, ids_b)) != raw:
            found.append(([], [], [], ""))
            continue
        over_a, over_b = spans(map(bytes_a, ids_a)), spans(map(bytes_b, ids_b))
        links, j = [], 0
        for i, (lo, hi) in enumerate(over_a):
            while over_b[j][1] <= lo:
                j += 1
            k = j
            while k < len(over_b) and over_b[k][0] < hi:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        count.update(links)
        ends = sorted({e for _, e in over_a} & {e for _, e in over_b})
        groups, p, q = [], 0, 0
        for end in ends:
            i, j = p, q
            while i < len(over_a) and over_a[i][1] <= end:
                i += 1
            while j < len(over_b) and over_b[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, ids_a[p:i])) + "|" + ",".join(map(str, ids_b[q:j])))
            p, q = i, j
        found.append((ids_a, ids_b, links, ";".join(groups)))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [
        (
            len(x), len(y), len(g.split(";")) if g else 0, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(g.encode()).hexdigest() if g else "",
        )
        for x, y, links, g in found
    ]


def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in enumerate(TEXTS)], "doc_id long, text string, row int, pairs string")
    got = {r[0]: tuple(r)[1:] for r in align.token_alignment(docs).collect()}
    assert got == dict(enumerate(alignment_by_hand(TEXTS)))


def test_alignment_of_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in align.token_alignment(docs).collect()}
    assert got == {r[0]: w for r, w in zip(rows, alignment_by_hand([r[1] for r in rows]), strict=True)}


def test_alignment_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert align.token_alignment(spark.createDataFrame([], schema)).count() == 0
    rows = align.token_alignment(spark.createDataFrame([(None, "one two"), (4, "one two"), (4, "one two"), (5, None)], schema)).collect()
    assert Counter((r[0], r["n_a"]) for r in rows) == {(None, 2): 1, (4, 2): 2, (5, 0): 1}
    groups = align.alignments(spark.createDataFrame([(1, "one two")], schema), public_tokenizers.path(align.BYTE_BPE), public_tokenizers.path(align.PIECES)).first()
    assert hashlib.sha256(groups["groups"].encode()).hexdigest() == groups["groups_sha256"] and groups["groups"].count("|") == groups["n_groups"]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    work = align.Aligner(*(s(public_tokenizers.path(p)) for s, p in ((align.ByteSide, align.BYTE_BPE), (align.PieceSide, align.PIECES))))
    texts = [t for t in TEXTS if t]
    want = [list(map(list, map(list, part))) if k > 3 else part for k, part in enumerate(work.aligned(texts))]
    work.held = {}
    work.older = {}
    monkeypatch.setattr(align, "mix64", lambda x: x & align.U64(1))
    got = [list(map(list, map(list, part))) if k > 3 else part for k, part in enumerate(work.aligned(texts))]
    assert got == want


def test_a_wide_pair_of_vocabularies_counts_alike():
    work = align.Aligner(*(s(public_tokenizers.path(p)) for s, p in ((align.ByteSide, align.BYTE_BPE), (align.PieceSide, align.PIECES))))
    want = work.aligned(TEXTS[:4])
    work.kind, work.held, work.older = np.int64, {}, {}
    got = work.aligned(TEXTS[:4])
    assert got[:4] == want[:4] and all((a == b).all() for a, b in zip(got[4] + got[5], want[4] + want[5], strict=True))


def links_by_hand(rows, least=0.93):
    best = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        kind = (f"{len(vector)}:{label}", [float(x) for x in vector])
        best[vec_id] = min(best.get(vec_id, kind), kind)
    ids = sorted(best)
    n, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            (kind, v), (other, w) = best[i], best[j]
            if kind == other:
                dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
                if dot(v, w) / (dot(v, v) ** 0.5 * dot(w, w) ** 0.5) >= least:
                    n[i] += 1
                    n[j] += 1
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (n[i], root(i)) for i in ids}


def near_rows(seed):
    free = np.random.default_rng(seed)
    rows, vec_id = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = free.normal(size=6)
            for _ in range(free.integers(1, 9)):
                # some within reach of all others, some at the threshold's other side
                rows.append((vec_id, [float(x) for x in centre + free.normal(size=6) * free.choice([0.001, 0.15, 0.3])], label))
                vec_id += 1
    rows += [(vec_id + k, rows[3][1], 0) for k in range(7)]
    rows += [(vec_id + 20, rows[3][1], 1), (vec_id + 21, rows[3][1], None), (vec_id + 22, [0.0] * 6, 0), (vec_id + 23, None, 0), (vec_id + 24, [1.0, None], 0)]
    rows += [(vec_id + 25, [float("nan")] * 6, 0), (vec_id + 26, [], 0), (vec_id + 27, [1.0, 2.0, 3.0], 0), (vec_id + 28, [1.0, 2.0, 3.1], 0), (2, rows[2][1], 0)]
    # cosine of exactly 0.93 up to rounding
    return rows + [(vec_id + 30, [1.0, 0.0], 5), (vec_id + 31, [0.93, (1 - 0.93**2) ** 0.5], 5), (vec_id + 32, [0.9299999, (1 - 0.9299999**2) ** 0.5], 5)]


@pytest.mark.parametrize("tile_rows", [3, 1024])
def test_near_vectors_equal_brute_force(spark, tile_rows):
    rows = near_rows(tile_rows)
    table = spark.createDataFrame([(*r, 7, "k") for r in rows] + [(None, [1.0, 0.0], 5, 7, "k")], "vec_id long, embedding array<double>, label int, n int, kind string")
    got = ego.near_vectors(table, tile_rows=tile_rows).collect()
    want = links_by_hand(rows)
    assert len(got) == len(rows) + 1
    for vec_id, n, component, kept in got:
        assert (n, component) == want.get(vec_id, (0, vec_id)) and kept == (component == vec_id)


def test_near_copies_in_one_group(spark):
    free = np.random.default_rng(3)
    centre = free.normal(size=8)
    rows = [(k, [float(x) for x in centre + free.normal(size=8) * 0.002], 1) for k in range(200)] + [(500 + k, [float(x) for x in free.normal(size=8)], 1) for k in range(100)]
    got = {r[0]: (r[1], r[2]) for r in ego.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile_rows=8).collect()}
    assert got == links_by_hand(rows)
    assert all(got[k] == (199, 0) or got[k][0] > 199 for k in range(200))


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ego.near_vectors(spark.createDataFrame([], schema)).count() == 0
    only = ego.near_vectors(spark.createDataFrame([(3, None, 1), (4, [1.0], None)], schema)).collect()
    assert sorted(map(tuple, only)) == [(3, 0, 3, True), (4, 0, 4, True)]


def damage_by_hand(rows):
    held = {}
    for conv, turn, role, text in rows:
        kept = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return held


STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def repair_by_hand(rows):
    """Of every state after each row, the least (cost, audit) with what it gives: all edits are tried."""
    out = {}
    for conv, kept in damage_by_hand(rows).items():
        kept.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        names = {"u": "user", "a": "assistant"}

        def better(held, state, way):
            if state not in held or way[:2] < held[state][:2]:
                held[state] = way

        def inserted(held):
            for _ in range(4):
                for state, (cost, audit, said) in list(held.items()):
                    for c in "ua":
                        if c in STEP[state]:
                            better(held, c, (cost + 5, audit + "I", (*said, names[c] + ":")))
            return held

        held = inserted({"": (0, "", ())})
        for (_, role, text), fault in zip(kept, faults, strict=True):
            new = {}
            for state, (cost, audit, said) in held.items():
                better(new, state, (cost + 2, audit + "D", said))
                if fault in ("", "truncated"):
                    cost += 5 * (fault == "truncated")
                    if role[:1] in STEP[state]:
                        better(new, STEP[state][role[:1]], (cost, audit + "K", (*said, f"{role}:{text}")))
                    for c in "ua":
                        if c in STEP[state]:
                            better(new, c, (cost + 1, audit + "R", (*said, f"{names[c]}:{text}")))
            held = inserted(new)
        cost, audit, said = min(held[s] for s in ("", "a") if s in held)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def odd_conversations(seed, n):
    pick = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "ugly", None, ""], ["a.", "b", "c!", "", " \t", "a. \n", "é?", " ", None, "x", "line\nbreak."]
    rows = [(None if c == 7 else c, pick.choice([None, *range(9)]), pick.choice(roles), pick.choice(texts)) for c in range(n) for _ in range(pick.randint(0, 12))]
    return [*rows, *rows[:20]]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("held", "piece"), [(20_000, 50_000), (3, 2), (0, 4)])
def test_repair_equals_brute_force(spark, held, piece):
    rows = odd_conversations(held, 150)
    table = spark.createDataFrame([(*r, "f", 3) for r in rows], CONVERSATIONS + ", fault string, n int")
    got = repair.repaired(repair.damaged(table), held, piece).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == repair_by_hand(rows) and len(got) == len({r[0] for r in rows})


def test_repair_of_the_conversations_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in repair.damaged_and_repaired(table).collect()} == repair_by_hand(rows)


def test_a_very_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t % 50}.") for t in range(30_000)]
    got = repair.damaged_and_repaired(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    short = repair.repaired(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)), held_rows=50_000).collect()
    assert got == short and len(got[0]["audit"]) >= 25_000


def test_no_conversations(spark):
    assert repair.damaged_and_repaired(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = repair.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "a.")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in only] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
