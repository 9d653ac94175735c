"""Cross-tokenizer alignment, packing and conversation repair against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from filecensus.llm import alignment, conversation_repair, kernel, packing, tokens
from tests.llm import fixture

SF = "/root/testdata/sf0.001"
ODD = [
    "don't  stop\n  now\t\tplease ", " leading and trailing  ", "<|endoftext|> and <|startoftext|>x", "a▁b", "▁", "<0x41> <s>",
    "Ünïcödé naïve ﬁ ½ ǅ", "日本語 の 文 字", "x" * 5000, "   wide spaces  here", "é ́ combining",
    "1234567890 3.14 A1B2", "'s 't 'RE it's IT'S", "\x00\x01", "!!!???...", "a\r\nb\x0bc", "İSTANBUL ΣΑΣ", "<b>bold</b>, <BOLD>",
    "a,b;c word,WORD,Word", " ", "\n", "\U0001f600\U0001f600 \U0001f468‍\U0001f469",
]


def library(name, plain):
    return tokens.library_tokenizer(tokens.tokenizer_path(name), plain)


@pytest.fixture(scope="module")
def texts():
    return [r[1] for r in fixture.rows()] + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k % 17 else None, t, "en", ["a", "b", "é", "", None][k % 7 % 5], 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], fixture.SCHEMA)


# --- alignment ---------------------------------------------------------------------------


def plain_alignment(texts):
    """(n_a, n_b, links, digest) of every text by whole-text tokens, without slices, pieces or arrays."""
    a, b = library(alignment.A_VOCABULARY, True), alignment.piece_level(tokens.tokenizer_path(alignment.B_VOCABULARY))
    spell = alignment.byte_level(tokens.tokenizer_path(alignment.A_VOCABULARY)).bytes
    out = []
    for text in texts:
        whole = f" {text or ''}"
        ids = a.encode(whole, add_special_tokens=False).ids, b.encode([whole])[0]
        parts = [[entries[i] for i in side] for entries, side in zip((spell, b.bytes), ids)]
        if not text or any(b"".join(p) != whole.encode() for p in parts):
            out.append((0, 0, [], ""))
            continue
        ends = [list(itertools.accumulate(map(len, p))) for p in parts]
        shared = sorted(set(ends[0]) & set(ends[1]))
        links, groups, i, j = [], [], 0, 0
        for end in shared:
            x, y = ends[0].index(end, i), ends[1].index(end, j)
            groups.append(",".join(map(str, ids[0][i : x + 1])) + "|" + ",".join(map(str, ids[1][j : y + 1])))
            links.append((ids[0][x], ids[1][y]))
            i, j = x + 1, y + 1
        out.append((len(ids[0]), len(ids[1]), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def plain_digests(texts):
    found = plain_alignment(texts)
    counts = Counter(link for _, _, links, _ in found for link in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (n_a, n_b, len(links), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links), digest)
        for n_a, n_b, links, digest in found
    ]


def test_merge_path_pieces_find_all_shared_ends():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 300):
        a, b = (np.unique(rng.integers(0, 2 * size + 1, size)) for _ in range(2))
        for work in (1, 2, 7, 64, 10_000):
            of_a, of_b = alignment.diagonals(a, b, work)
            assert (np.diff(of_a + of_b)[:-1] == work).all() and (of_a[-1], of_b[-1]) == (len(a), len(b))
            i, j = alignment.shared_ends(a, b, work)
            assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_alignment_matches_whole_text_tokens(docs, texts):
    found = alignment.alignment_digests(fixture.clashing(docs.repartition(3)))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain_digests([*texts, *texts[:2]])
    ids = [k if k % 17 else None for k in range(len(texts))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, *w) for i, w in zip([*ids, *ids[:2]], want)), key=repr)


def test_rare_pairs_are_joined(docs):
    """The pairs that do not travel to the tasks give the same sums."""
    found = alignment.aligned(docs).drop("groups").withColumn("row", F.monotonically_increasing_id())
    found = alignment.stored(found, "aligned")
    width = alignment.piece_count(tokens.tokenizer_path(alignment.B_VOCABULARY))
    whole, some, none = (sorted(map(tuple, alignment.with_link_counts(found, width, most).collect()), key=repr) for most in (1 << 20, 40, 0))
    assert whole == some == none


def test_alignment_of_no_rows(docs):
    assert alignment.alignment_digests(docs.limit(0)).count() == 0


def test_registered_alignment(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = [(i, *w) for (i, _), w in zip(rows, plain_digests([t for _, t in rows]))]
    assert sorted(map(tuple, contract.queries()["op11_cross_tokenizer_alignment"](spark, SF).collect())) == sorted(want)


# --- packing -----------------------------------------------------------------------------


def whole_ids(texts):
    tokenizer = library(packing.VOCABULARY, False)
    return [[*e.ids, packing.END] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def checked_pieces(pieces, width):
    """Rows of the pieces, after checking that every sequence is full and without gaps."""
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    lengths = Counter()
    for r in rows:
        assert r.offset == lengths[r.sequence_id] and r.length > 0 and len(r.ids) == 4 * r.length
        lengths[r.sequence_id] += r.length
    assert sorted(lengths) == list(range(len(lengths)))
    short = [n for _, n in sorted(lengths.items()) if n != width]
    assert all(n < width and n & (n - 1) == 0 for n in short) and short == sorted(set(short), reverse=True)
    return rows


def test_words_cut_for_the_cache_keep_their_ids(texts):
    known = tokens.SliceIds(tokens.word_encoder(tokens.tokenizer_path(packing.VOCABULARY)))
    for block in kernel.blocks(pa.array(texts), 3000):
        found = tokens.between_spaces(block)
        ids, counts = known.ids(known.lookup(block, found, packing._hashes(block, found)))
        sizes = tokens.per_row(counts, found.bounds)
        own = np.split(ids, np.cumsum(sizes)[:-1])
        assert [[*o, packing.END] for o in own] == whole_ids(texts[block.first : block.first + block.rows])


@pytest.mark.parametrize("width", [64, 4096])
def test_pieces_are_the_documents_in_proportion(docs, texts, width):
    pieces = packing.pack(fixture.clashing(docs.repartition(3)), width=width)
    rows = checked_pieces(pieces, width)
    documents = defaultdict(list)
    for r in rows:
        documents[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    want = Counter()
    for k, ids in enumerate(whole_ids([*texts, *texts[:2]])):
        k %= len(texts)
        want[(k if k % 17 else None), np.array(ids, "<u4").tobytes()] += 1
    found = Counter()
    for (doc_id, size), parts in documents.items():
        at, open_ = sorted(parts), []
        for start, ids in at:  # documents of equal id and length run side by side
            home = next((o for o in open_ if len(o) // 4 == start), None) if start else None
            if home is None:
                assert start == 0
                open_.append(bytearray(ids))
            else:
                home += ids
        for o in open_:
            assert len(o) == 4 * size
            found[doc_id, bytes(o)] += 1
    singles = {k for k, n in Counter(d for d, _ in want).items() if n == 1 and k is not None}
    assert {k: n for k, n in found.items() if k[0] in singles} == {k: n for k, n in want.items() if k[0] in singles}
    assert sum(map(len, (r.ids for r in rows))) == sum(len(k[1]) * n for k, n in want.items())
    total = sum(r.length for r in rows)
    share, held = Counter(), defaultdict(Counter)
    for r in rows:
        share[r.source] += r.length
        held[r.sequence_id][r.source] += r.length
    for sequence in range(total // width):
        for source, n in share.items():
            assert abs(held[sequence][source] - width * n / total) <= len(share) + 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, packing.pack(docs.repartition(3), width=width).collect()), key=repr)


def test_weights_hold_until_a_source_runs_dry(docs):
    weights = {"a": 3.0, "b": 1.0, "é": 0.25, None: 1.0}
    rows = checked_pieces(packing.pack(docs, weights, width=128), 128)
    left, held = Counter(), defaultdict(Counter)
    for r in rows:
        left[r.source] += r.length
        held[r.sequence_id][r.source] += r.length
    weight = {s: weights.get(s, 1.0) for s in left}
    for sequence in range(len(held) - 12):
        mine = held[sequence]
        lasting = [s for s in left if left[s] > 300]
        if len(lasting) == len([s for s in left if left[s] > 0]):
            for s in lasting:
                assert abs(mine[s] - 128 * weight[s] / sum(weight[x] for x in lasting)) <= len(weight) + 1
        left.subtract(mine)


def test_rounds_are_found_again():
    rng = np.random.default_rng(8)
    for _ in range(20):
        sizes = rng.integers(1, 5000, rng.integers(1, 7))
        rounds = packing.Rounds(sizes, rng.choice([0.001, 0.3, 1.0, 7.0], len(sizes)), 64)
        number = np.arange(rounds.count + 1)
        for k in range(len(sizes)):
            sent = rounds.sent(np.full(len(number), k), number)
            assert sent[0] == 0 and sent[-1] == sizes[k] and (np.diff(sent) >= 0).all()
            tokens_ = np.arange(sizes[k])
            assert rounds.round_of(np.full(sizes[k], k), tokens_).tolist() == (np.searchsorted(sent, tokens_, side="right") - 1).tolist()


def test_packing_of_no_rows_and_sequences(docs):
    assert packing.pack(docs.limit(0)).count() == 0
    pieces = packing.pack(docs.where("doc_id < 9"), width=256)
    ids = {(r.sequence_id, r.offset): r.ids for r in pieces.collect()}
    for r in packing.sequences(pieces).collect():
        assert bytes(r.ids) == b"".join(bytes(ids[r.sequence_id, s.offset]) for s in r.segments) and len(r.ids) == 4 * r.length


def test_registered_packing(spark):
    rows = contract.queries()["op12_packing"](spark, SF).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    ids = dict(zip(texts, whole_ids(texts.values())))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])


# --- conversations -----------------------------------------------------------------------

FORM, BEGUN = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")
ENDS = re.compile(r"[^ \t-\r]")


def plain_repair(rows):
    """Edit sequences by cost and text until the first that gives the form: (cost, audit, repaired rows)."""
    ways = [(0, "", 0, ())]
    while True:
        cost, audit, at, done = heapq.heappop(ways)
        initials = "".join(role[:1] for role, _ in done)
        if not BEGUN.fullmatch(initials):
            continue
        if at == len(rows) and FORM.fullmatch(initials):
            return cost, audit, list(done)
        for role in ("user", "assistant"):
            heapq.heappush(ways, (cost + 3, audit + "I", at, (*done, (role, ""))))
        if at < len(rows):
            role, text, must_go, extra = rows[at]
            heapq.heappush(ways, (cost + 4, audit + "D", at + 1, done))
            if not must_go:
                if role:  # a row without a role cannot stay as it is
                    heapq.heappush(ways, (cost + extra, audit + "K", at + 1, (*done, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(ways, (cost + 3 + extra, audit + "R", at + 1, (*done, (new, text))))


def test_survivors_against_all_edit_sequences():
    rng = random.Random(4)
    for n in range(300):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system", "tool", ""], ["system", "user"]])
        rows = [(rng.choice(roles), f"t{k}", rng.random() < 0.2, 3 * (rng.random() < 0.3)) for k in range(n % 5)]
        survivors, edits = conversation_repair.Survivors(), []
        for role, text, must_go, extra in rows:
            edits += survivors.step(role, text, must_go, extra > 0)
        edits += survivors.finish()
        cost, audit, done = plain_repair(rows)
        assert sum(e[3] for e in edits) == cost and "".join(e[0] for e in edits) == audit, rows
        assert [(e[1], e[2]) for e in edits if e[0] != "D"] == done


def test_settled_edits_leave_the_tree():
    rng = random.Random(6)
    survivors, open_, most = conversation_repair.Survivors(), 0, 0
    for k in range(20_000):
        settled = survivors.step(rng.choice(["user", "assistant"]), "x.", rng.random() < 0.1, rng.random() < 0.1)
        open_ += 1 - sum(e[0] != "I" for e in settled)
        most = max(most, open_)
    assert most < 200


def plain_conversations(rows):
    """The contract, conversation by conversation."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        mine = groups[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub(r"[.!?]", "", text) if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, seen, given = Counter(), set(), []
        for _, role, text in mine:
            marks = ENDS.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            given.append((role, text, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, done = plain_repair(given)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def digests(rows):
    found = conversation_repair.summaries(conversation_repair.repair(conversation_repair.with_faults(conversation_repair.damaged(rows))))
    return sorted(map(tuple, found.collect()), key=repr)


def test_registered_repair(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    found = contract.queries()["op13_conversation_repair"](spark, SF)
    assert found.columns == ["conv_id", *conversation_repair.COUNTS, "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_conversations(rows)


def test_repair_of_awkward_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, odd roles, blank and long texts, extra columns."""
    rng = random.Random(12)
    texts = [None, "", " \t\n", "a.", "a. ", "no end", "é!", " ", "long " * 4000 + "?"]
    rows = [
        (rng.choice([None, 1, 2, 3, *range(10, 60)]), rng.choice([None, 0, 1, 1, 2, 9]),
         rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts))
        for _ in range(170)
    ]
    rows += rows[:20]
    kept, sizes = [], Counter()
    for r in rows:  # trying all sequences is slow beyond a few rows
        if sizes[r[0]] < 4:
            sizes[r[0]] += 1
            kept.append(r)
    schema = "conv_id long, turn long, role string, text string"
    given = spark.createDataFrame(kept, schema).repartition(3)
    extra = given.select("*", *(F.lit("own").alias(n) for n in ("fault", "dropped", "copy", "edit", "cost", "audit")))
    assert digests(extra) == plain_conversations(kept)
    assert digests(given.limit(0)) == []


def test_a_conversation_over_many_batches(spark):
    """Thousands of rows of one conversation between small ones, in Arrow batches of 64 rows."""
    rows = [(7, k, "user" if k % 2 else "assistant", f"text {k % 900}.") for k in range(4000)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", "hello.") for c in range(20, 40) for k in range(2)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = digests(given)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert digests(given) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    big = next(r for r in whole if r[0] == 7)
    survivors, edits = conversation_repair.Survivors(), []
    again = conversation_repair.repair(conversation_repair.with_faults(conversation_repair.damaged(given))).where("conv_id = 7 AND edit != 'D'")
    for r in again.collect():
        edits.append(f"{r.role}:{r.text}")
    assert hashlib.sha256("\n".join(edits).encode()).hexdigest() == big[-1]
    assert FORM.fullmatch("".join(e[:1] for e in edits)) and survivors.finish() == []
