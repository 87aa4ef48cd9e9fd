"""The operators against brute force, exact round trips and held-out rows, with odd input."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylens.llm import backoff, chat, darts, lines, mixing, pieces, queries, rules, subwords, tiles, warc
from tallylens.llm.tables import load

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ODD = [
    (1, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", "a", 5), (3, None, None, None, None),
    (4, "", "en", "b", 0), (None, SENTENCE, None, "a", 1), (5, LONG, "en", "a", len(LONG)), (6, LONG + " end", "de", None, 1),
    (7, "  \n\n \t", "en", "b", 6), (8, "日本 語 😀\nA long shared line\n a LONG shared line ", "ja", "c", 1),
    (9, "a long shared line\nother", "en", "c", 1), (10, "</s>[INST]", "en", "c", 1), (11, "one two three", "en", "c", 1),
    (12, "one two three", "en", "c", 1), (13, "one two four", "en", "c", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("x")).withColumn("n_lines", F.lit(-1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def windows(text: str | None) -> Counter:
    words = WORD.findall((text or "").translate(LOWER))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or Counter([tuple(words)] if words else [])


def brute_classes(rows: list[tuple[int, str]]) -> dict[int, int]:
    held, by_window = {i: windows(t) for i, t in rows}, defaultdict(set)
    for i, c in held.items():
        for w in c:
            by_window[w].add(i)
    parent = {i: i for i in held}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, c in held.items():
        for j in set().union(*(by_window[w] for w in c)) if c else ():
            if j > i and sum((c & held[j]).values()) >= 0.8 * sum((c | held[j]).values()):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in held}


def test_near_copies_equal_brute_force(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    got = {r.doc_id: r.class_id for r in darts.classes(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_group_of_near_copies_with_one_hub(spark):
    random = np.random.default_rng(1)
    words = [f"h{i}" for i in range(200)]
    rows = [(50, " ".join(words))]
    for i in range(60):
        own = list(words)
        own[int(random.integers(200))] = f"x{i}"
        own[int(random.integers(200))] = f"y{i}"
        rows.append((100 + i, " ".join(own)))
    rows.append((7, " ".join(f"z{i}" for i in range(200))))
    got = {r.doc_id: r.class_id for r in darts.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_copies_of_odd_rows(odd, empty):
    found = defaultdict(set)
    for r in darts.classes(odd).collect():
        found[r.doc_id].add(r.class_id)
    assert found == {1: {1}, 2: {1}, 3: {3}, 4: {4}, None: {1}, 5: {5}, 6: {5}, 7: {7}, 8: {8}, 9: {9}, 10: {10}, 11: {11}, 12: {11}, 13: {13}}
    assert darts.classes(empty).count() == 0
    kept = darts.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 3, 4, 5, 7, 8, 9, 10, 11, 13]


def test_near_copies_with_repeated_and_null_ids(spark):
    """Every row is a document: no text is lost with a repeated id, a null id is never the smallest of its class."""
    a, b, c = ("the quick brown fox jumps over the lazy dog near the old mill " * 2, SENTENCE, "no id has this text but two rows do hold it here")
    rows = [(1, a), (7, a), (7, b), (9, b), (None, b), (None, c), (None, c), (7, b)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in darts.classes(frame).collect()), key=str)
    assert got == sorted([(1, 1, 2), (7, 1, 2), (7, 7, 4), (9, 7, 4), (None, 7, 4), (None, None, 2), (None, None, 2), (7, 7, 4)], key=str)
    assert sorted(((r.doc_id, r.text) for r in darts.deduplicated(frame).collect()), key=str) == sorted([(1, a), (7, b), (None, c)], key=str)


def test_texts_that_share_a_passage_meet_few_others(spark, monkeypatch):
    """Half of each text is one passage; a few have a near copy. Pairs that are compared stay far below all pairs."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"o{i}x{k}" for k in range(60))])) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + f" more{i}") for i in range(0, 600, 40)]
    rows += [(3000 + i, " ".join([*passage[: 59 - i % 5], f"e{i}"])) for i in range(200)]  # near copies of the passage
    made = []
    real = darts.compared
    monkeypatch.setattr(darts, "BANDS", 60)
    monkeypatch.setattr(darts, "ROWS", 2)  # texts of similarity 1/3 share most of their buckets
    monkeypatch.setattr(darts, "compared", lambda pairs, windows: (made.append(pairs.count()), real(pairs, windows))[1])
    got = {r.doc_id: r.class_id for r in darts.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_classes(rows)
    assert sum(made) < 10 * len(rows)


def moved(spark, monkeypatch, run, column="text") -> list[str]:
    """The exchanges that a column goes through, with joins by broadcast off, in all that ``run`` writes and returns."""
    plans = []

    def planned(df):
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        plans.extend(part for part in text.split("\n\n") if re.match(r"\(\d+\) Exchange", part) and re.search(rf"\b{column}#", part))

    real = darts.staged
    monkeypatch.setattr(darts, "staged", lambda df, name: (planned(df), real(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        planned(run())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plans


def test_classes_move_no_texts(spark, sf_dir, monkeypatch):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    assert moved(spark, monkeypatch, lambda: darts.classes(docs)) == []


def test_classes_move_windows_only_to_their_cells(spark, sf_dir, monkeypatch):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    made, real = [], darts.compared
    monkeypatch.setattr(darts, "compared", lambda pairs, windows: (made.append(1), real(pairs, windows))[1])
    plans = moved(spark, monkeypatch, lambda: darts.classes(docs), "items")
    assert made and len(plans) == len(made)


def test_deduplicated_moves_rows_once(spark, sf_dir, monkeypatch):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    written = []
    real = darts.staged
    monkeypatch.setattr(darts, "staged", lambda df, name: (written.append("text" in df.columns), real(df, name))[1])
    assert len(moved(spark, monkeypatch, lambda: darts.deduplicated(docs))) == 1
    assert not any(written)  # a second copy of the texts


def test_deduplicated_tells_rows_with_shifted_nulls_apart(spark):
    """Hashes of all values skip nulls: these rows share theirs, but not their texts."""
    a, b = SENTENCE, " ".join(SENTENCE.split()[::-1])
    rows = [(a, 1, b, None), (None, 1, a, b), (a, 1, None, b), (a, 2, b, None)]
    frame = spark.createDataFrame(rows, "lang string, doc_id bigint, text string, source string")
    kept = sorted(((r.doc_id, r.text) for r in darts.deduplicated(frame).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (1, None)], key=str)


def test_classes_when_all_ids_share_a_mark(spark, sf_dir, monkeypatch):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    monkeypatch.setattr(darts, "_mark", lambda column: F.lit(5).cast("long"))
    assert {r.doc_id: r.class_id for r in darts.classes(docs).collect()} == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_chat_of_one_long_conversation(spark):
    """Time in proportion to the turns: a quadratic formatter needs minutes here."""
    import time

    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s> [INST]") for i in range(16_000)]
    rows += [(2, i, "assistant", f"part {i}.") for i in range(16_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    begun = time.monotonic()
    got = {r.conv_id: r for r in chat.digests(chat.chat(frame)).collect()}
    assert time.monotonic() - begun < 30
    for conv in (1, 2):
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()


def test_dart_signatures_estimate_weighted_similarity():
    random = np.random.default_rng(5)
    base = random.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(np.concatenate([base, base[:100]])), np.sort(np.concatenate([base[:300], base[:100]]))
    both = darts.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
    assert (both != 0).mean() > 0.99
    assert abs((both[0] == both[1]).mean() - 400 / 500) < 0.12
    alone = darts.signatures(a, np.array([len(a)]))
    assert (alone[0] == both[0]).all()


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute_pages(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    largest = defaultdict(lambda: warc.NO_ID)
    for i, html in rows:
        largest[html or ""] = max(largest[html or ""], warc.NO_ID if i is None else i)
    out = []
    for i, html in rows:
        data, top = (html or "").encode(), largest[html or ""]
        kept = (warc.NO_ID if i is None else i) == top
        out.append((i, len(data), b32(data), "response" if kept else "revisit", None if kept else top))
    return sorted(out, key=str)


TRICKY = [
    (1, "u", "x"), (2, None, "x"), (2, "u", "x"), (3, "é\r\nx: y", None), (4, "u", ""), (None, "u", "x"), (None, "u", "alone"),
    (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (6, "u", "\r\n\r\n"), (7, "u", "日本" * 100_000 + "\r\n\r\n"),
    (8, "u", "0\r\n\r\n"), (9, "u", "\r\n" * 40_000 + "WARC/1.1\r\n"), (-3, "u", "y\n")]


def archived(spark, rows, tmp_path):
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), f"{tmp_path}/a.warc")
    return warc.read(spark, f"{tmp_path}/a.warc")


def test_archives_of_tricky_pages(spark, tmp_path):
    found = archived(spark, TRICKY, tmp_path).collect()
    assert {r.problem for r in found} == {None}
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == brute_pages(
        [(i, html) for i, _, html in TRICKY])
    texts = {r.page_id: bytes(r.payload) for r in found if r.record_type == "response"}
    assert texts[5].decode() == TRICKY[7][2] and max(r.segments for r in found) > 5
    assert archived(spark, [], tmp_path / "none").count() == 0


def test_no_segment_or_chunk_begins_with_a_first_line(spark, tmp_path):
    lines_only = [(i, "u", "x" * i + "WARC/1.1\r\n" * 30_000) for i in range(10)]
    with_ends = [(20 + i, "u", "x" * i + "y\r\nWARC/1.1\r\n" * 30_000) for i in range(13)]
    rows = [*lines_only, *with_ends, (40, "u", "\r\nWARC/1.1\r\n"), (41, "u", "z" * warc.CHUNK + "\r\nWARC/1.1\r\nz")]
    found = archived(spark, rows, tmp_path).collect()
    assert {r.problem for r in found} == {None}
    assert {r.page_id: bytes(r.payload).decode() for r in found} == {i: html for i, _, html in rows} and len(found) == len(rows)


def test_archives_of_all_pages(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in load(spark, sf_dir, "pages", "page_id", "html").collect()]
    found = queries.archives(spark, sf_dir).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == brute_pages(rows)


def test_damaged_segments_are_reported(spark, tmp_path):
    path = f"{tmp_path}/b.warc"
    parts = list(warc.records(1, "u", b"q" * 200_000, None, "2020-01-01T00:00:00Z"))
    assert len(parts) == 4

    def problem(rows):
        text = spark.createDataFrame([(bytearray(warc.VERSION + r),) for r in rows], "value binary")
        text.select(F.col("value").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path, lineSep="\r\n\r\n")
        return [r.problem for r in warc.read(spark, path).collect()]

    assert problem(reversed(parts)) == [None]
    assert problem(parts[:2] + parts[3:]) == ["segments are missing"]
    assert problem(parts[:3]) == ["segments are missing"]
    assert problem([*parts[:3], re.sub(rb"Total-Length: \d+", b"Total-Length: 9", parts[3])]) == ["the total length differs"]
    chunk = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    for framing in (b"1\r\nx\r\n-6\r\n0\r\n\r\n", b"+1\r\nx\r\n0\r\n\r\n", b"z\r\n", b"\r\n\r\n", b"ffffffffffff\r\nx"):
        assert "chunk" in problem([warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:a>"}, chunk + framing)])[0]
    good = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:b>"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    for name, value in (("Content-Length", "abc"), ("WARC-Segment-Number", "one"), ("WARC-Segment-Number", "9" * 30), ("Content-Length", "-1")):
        odd_record = f"WARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\n{name}: {value}\r\n\r\nbody".encode()
        assert sorted(map(str, problem([odd_record, good, good]))) == ["None", "None", "a stated number is malformed"]
    old = str(tmp_path / "old.warc")
    (tmp_path / "old.warc").write_bytes(b"".join(b"WARC/1.0\r\n" + good + b"\r\n\r\n" for _ in range(3)))
    assert [r.problem for r in warc.read(spark, old).collect()] == [None] * 3
    assert problem([warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1:a>", "WARC-Target-URI": "urn:page:1"},
                                b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n")]) == ["a chunk is not as long as stated"]


def test_vectors_with_ties_and_unusable_rows(spark):
    random = np.random.default_rng(3)
    hot = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, hot if i % 3 == 0 else (random.integers(-9, 9, 4) / 4 + 0.125).tolist()) for i in range(400)]  # exact sums
    rows += [(1000, None), (1020, [0.0] * 4), (1040, [float("nan"), 1.0, 1.0, 1.0]), (1060, [None, 1.0, 1.0, 1.0]),
             (None, hot), (1080, [float("inf"), 0.0, 0.0, 0.0]), (3, hot), (1100, [1.0, 2.0])]
    usable = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = defaultdict(list)
    frame = spark.createDataFrame(rows, T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])).withColumn("v", F.lit(1))
    for r in tiles.search(frame).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in (i for i in usable if i % 20 == 0 and i < 1000):
        want = sorted(((-float(np.dot(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == 4))[:20]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
        assert np.allclose([s for *_, s in sorted(got[q])], [-s for s, _ in want])
    assert set(got) == {i for i in usable if i % 20 == 0 and i < 1000}
    assert tiles.search(frame.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<*/s>", "<s>", "[**INST]", "", None, "a\nb", "😀" * 3, "x" * 100_000]
    rows = [(1, i, ("user", "assistant")[i // 2 % 2], t) for i, t in enumerate(texts)]
    rows += [(2, 0, None, "n"), (2, None, "<s>r", "first"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (None, 0, "user", "z")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    written = chat.chat(frame)
    back = {r.conv_id: r for r in written.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert back[1].loss == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert [tuple(t) for t in back[2].turns] == [("<s>r", "first"), ("", "n"), ("assistant", "same"), ("assistant", "same")]
    assert back[2].formatted.count("<s>") == 3 and len(back) == 3
    assert chat.digests(chat.chat(frame.limit(0))).count() == 0


def test_pieces_agree_and_round_trip(spark, odd, empty, sf_dir):
    rows = pieces.encode(odd).collect()
    assert all(r.parity and r.round_trip for r in rows) and len(rows) == len(ODD)
    assert {r.n_tokens for r in rows if not r.text} == {0}
    assert pieces.encode(empty).count() == 0
    made = pieces.encode(spark.createDataFrame([(1, "▁ x")], "doc_id long, text string")).collect()[0]
    assert made.parity and not made.round_trip
    checked = queries.piece_ids(spark, sf_dir).agg(F.min("parity").alias("p"), F.min("round_trip").alias("r")).first()
    assert checked.p and checked.r


def brute_scores(rows: list[tuple[int, str | None]], least: int = 2) -> dict[int, tuple]:
    texts = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    pairs = Counter(p for _, w in texts for p in zip([None, *w], w, strict=False))
    fronts, words = Counter(), Counter()
    for (a, b), n in pairs.items():
        fronts[a] += n
        words[b] += n
    total, out = sum(words.values()), defaultdict(lambda: [0, 0, 0.0])
    for i, w in texts:
        own = out[i]
        for a, b in zip([None, *w], w, strict=False):
            seen = pairs[a, b] >= least
            own[0] += 1
            own[1] += not seen
            own[2] += np.log(pairs[a, b] / fronts[a]) if seen else np.log(0.4 * words[b] / total)
    return out


def test_backoff_scores_equal_brute_force(spark, odd, empty, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    for frame in (docs, odd):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        want = brute_scores(rows)
        got = {r.doc_id: r for r in backoff.score(frame).collect()}
        assert set(got) == {i for i, _ in rows}
        for i, r in got.items():
            assert (r.n_words, r.n_backed_off) == tuple(want[i][:2]) and r.log_score == pytest.approx(want[i][2])
    assert backoff.score(empty).count() == 0


def brute_levels(rows: list[tuple[int, str | None]], least: int, order: int) -> dict[int, list]:
    texts = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    counts, contexts = Counter(), Counter()

    def grams(words, at):
        padded = [None] * (order - 1) + words
        return [tuple(padded[at + order - n : at + order]) for n in range(order, 0, -1)]

    for _, words in texts:
        for at in range(len(words)):
            for gram in grams(words, at):
                counts[gram] += 1
                contexts[gram[:-1]] += 1
    out = defaultdict(lambda: [0, 0, 0.0])
    for i, words in texts:
        own = out[i]
        for at in range(len(words)):
            factor = 1.0
            for gram in grams(words, at):
                if len(gram) == 1 or counts[gram] >= least:
                    break
                factor *= 0.4
            own[0] += 1
            own[1] += len(gram) < order
            own[2] += np.log(factor * counts[gram] / contexts[gram[:-1]])
    return out


@pytest.mark.parametrize("least, order", [(2, 3), (1, 3), (3, 4), (2, 1)])
def test_backoff_goes_level_by_level(spark, odd, sf_dir, least, order):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    for frame in (docs, odd):
        want = brute_levels([(r.doc_id, r.text) for r in frame.collect()], least, order)
        got = {r.doc_id: r for r in backoff.score(frame, least, order).collect()}
        for i, r in got.items():
            assert (r.n_words, r.n_backed_off) == tuple(want[i][:2]) and r.log_score == pytest.approx(want[i][2])


def test_quality_on_held_out_rows(spark, sf_dir):
    scored = queries.quality(spark, "/root/testdata/sf0.01")
    labels = load(spark, "/root/testdata/sf0.01", "labels", "doc_id", "quality").dropDuplicates(["doc_id"])
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) >= 0.8


def test_odd_rows_keep_their_columns(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None), (8, 1), (8, 0)], "doc_id bigint, quality int")
    scorer = subwords.train(odd, labels)
    scored = subwords.score(odd, scorer)
    assert set(scored.columns) == set(odd.columns) and scored.count() == len(ODD)
    assert scored.where("score between 0 and 1").count() == len(ODD)
    assert subwords.score(empty, subwords.train(empty, labels)).count() == 0
    judged = rules.judge(odd, rules.train(odd, labels))
    assert judged.count() == len(ODD) and rules.judge(empty, rules.train(empty, labels)).count() == 0
    assert judged.where("doc_id = 3").first().base_failed
    mixed = mixing.mix(odd)
    assert mixed.count() == len(ODD) and mixed.where("taken > 3 * size").count() == 0 and mixing.mix(empty).count() == 0


def test_rule_counts_equal_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in load(spark, sf_dir, "documents", "doc_id", "text").collect()}
    for r in queries.rule_forest(spark, sf_dir).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(marked))
        assert r.base_failed == (len(words) < 50 or 100 * len(marked) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_forest_learns_from_all_labelled_rows(spark):
    # a bounded sample by the hash of doc_id would leave out the only bad document
    last = spark.range(4100).orderBy(F.xxhash64("id").desc()).first().id
    texts = [(i, " ".join(f"w{(i * 7 + k * k) % 5000}" for k in range(60))) for i in range(4100) if i != last]
    docs = spark.createDataFrame([*texts, (last, " ".join(f"#{k}!%A" for k in range(60)))], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", f"CAST(doc_id <> {last} AS INT) AS quality")
    judged = rules.judge(docs, rules.train(docs, labels))
    assert [r.doc_id for r in judged.where("not kept").collect()] == [last]


def test_forest_paths_equal_brute_force():
    random = np.random.default_rng(5)
    shares = random.random((900, len(rules.SHARES))) ** 3
    shares[:, 2] = 0.25
    cuts = rules.draw_cuts(np.stack([shares.min(0), shares.max(0)]))
    ends = [cuts.leaves(t, shares) for t in range(rules.TREES)]
    forest = rules.forest_of(cuts, np.stack([np.bincount(e, minlength=1 << rules.DEPTH) for e in ends]))
    total = np.zeros(len(shares))
    for end in ends:
        todo = np.ones(len(shares), bool)
        for depth in range(rules.DEPTH + 1):
            half = end >> (rules.DEPTH - depth)
            weight = np.bincount(half)[half] * rules.PER_TREE / len(shares)
            stop = todo & ((weight <= 1) | (depth == rules.DEPTH))
            total[stop] += (depth + rules.usual_path(weight))[stop]
            todo &= ~stop
    assert forest.score(shares) == pytest.approx(2 ** (-total / rules.TREES / rules.usual_path(rules.PER_TREE)))


@pytest.mark.parametrize("dear, bad", [(10, 0.3), (1, 0.5), (0.1, 0.5), (10, 0), (10, 1)])
def test_threshold_equals_brute_force(spark, dear, bad):
    random = np.random.default_rng(3)
    rows = [(bool(random.random() >= bad), round(float(random.random()), 3) * 0.2 + 0.3) for _ in range(600)]
    found = rules.calibrated(spark.createDataFrame(rows, "good boolean, score double").repartition(4), dear)
    ranked = sorted({v for _, v in rows})
    edges = [(ranked[max(i - 1, 0)] + v) / 2 for i, v in enumerate(ranked)] + [2.0]
    cost = [sum(v < at if not good else dear * (v >= at) for good, v in rows) for at in [*ranked, 2.0]]
    assert found == edges[int(np.argmin(np.round(cost, 6)))]


def test_lines_of_odd_rows(odd, empty):
    left = {r.doc_id: r for r in lines.drop_lines(odd).collect() if r.doc_id is not None}
    assert left[8].text == "日本 語 😀\nA long shared line\n a LONG shared line " and left[9].text == "other"
    assert (left[9].n_lines, left[9].n_dropped) == (2, 1) and left[2].text == "" and left[1].text == SENTENCE
    assert (left[3].n_lines, left[3].text) == (1, "") and lines.drop_lines(empty).count() == 0


def test_perfect_hash_numbers_all_keys():
    keys = np.unique(np.random.default_rng(2).integers(1, 2**63, 50_000, dtype=np.uint64))
    table = lines.PerfectHash.build(keys)
    assert sorted(table.number(keys).tolist()) == list(range(len(keys)))


def test_training_rows_are_held_in_two_arrays(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(subwords, "descend", lambda found, **_: rows.extend(found))
    docs = [(i, f"word{i} and {'more ' * i}") for i in (9, 3, 7, 1)]
    labels = spark.createDataFrame([(i, i % 4 // 2) for i, _ in docs], "doc_id bigint, quality int")
    subwords.train(spark.createDataFrame(docs, "doc_id bigint, text string"), labels)
    assert [label for _, _, label in rows] == [0, 1, 1, 0]  # by doc_id
    for (ids, counts, _), (_, text) in zip(rows, sorted(docs), strict=True):
        found = np.concatenate([b for b, _ in subwords.features(pa.array([text]))])
        assert [ids.tolist(), counts.tolist()] == [x.tolist() for x in np.unique(found, return_counts=True)]
    assert len({id(ids.base) for ids, _, _ in rows}) == len({id(counts.base) for _, counts, _ in rows}) == 1


def test_pipeline_stages(spark, odd, empty, sf_dir):
    import corpus_pipeline as p

    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, odd, empty):
        for name, stage in p.STAGES:
            after = stage(spark, frame, sf_dir)
            if name != p.STAGES[-1][0]:
                if "score" in frame.columns:  # columns with the names of an operator's own pass unchanged
                    assert after.select("score", "n_lines").distinct().collect() == [("x", -1)]
                assert after.columns == frame.columns
                if name != "mixing sources to target weights":
                    assert not Counter(r.doc_id for r in after.select("doc_id").collect()) - Counter(r.doc_id for r in frame.select("doc_id").collect())
            frame = after
    assert p.run(spark, sf_dir).where("not parity").isEmpty()


def test_pipeline_stages_keep_the_right_rows(spark, sf_dir):
    import math

    import corpus_pipeline as p
    import duckdb

    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars").cache()
    scorer = subwords.train(docs, load(spark, sf_dir, "labels", "doc_id", "quality"))
    scores = {r.doc_id: r.score for r in subwords.score(docs, scorer).collect()}
    first = p.quality(spark, docs, sf_dir).cache()
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect() if scores[r.doc_id] >= p.REJECT)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in first.collect()) == rows and len(rows) > 100

    keeper: dict[str, int] = {}
    for i, text, _ in rows:
        for line in text.split("\n"):
            keeper.setdefault(line.strip(" \t\n\v\f\r").translate(LOWER), i)
    want = []
    for i, text, size in rows:
        own = text.split("\n")
        left = [x for x in own if len(k := x.strip(" \t\n\v\f\r").translate(LOWER)) < 10 or keeper[k] == i]
        if len(left) == len(own) or WORD.search("\n".join(left)):
            want.append((i, "\n".join(left), size if len(left) == len(own) else len("\n".join(left))))
    second = p.lines_once(spark, first, sf_dir).cache()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in second.collect()) == want != rows

    classes = brute_classes([(i, text) for i, text, _ in want])
    third = p.near_copies(spark, second, sf_dir).cache()
    assert sorted((r.doc_id, r.text) for r in third.collect()) == [(i, t) for i, t, _ in want if classes[i] == i]

    con = duckdb.connect()
    con.register("documents", third.toArrow())
    taken = con.execute(mixing.SQL).fetchall()
    times = {i: math.ceil(n / size) if size else 1 for i, size, _, _, n in taken}
    fourth = p.mixed(spark, third, sf_dir)
    assert Counter(r.doc_id for r in fourth.collect()) == Counter({i: n for i, n in times.items() if n})


def test_backoff_of_many_runs_and_hash_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(backoff, "PART_GRAMS", 256)
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.collect()
    want = brute_levels([(r.doc_id, r.text) for r in rows], 2, 3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r for r in backoff.score(docs, order=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(got) == {r.doc_id for r in rows}
    for i, r in got.items():
        assert (r.n_words, r.n_backed_off) == tuple(want[i][:2]) and r.log_score == pytest.approx(want[i][2])


def test_backoff_notices_runs_that_changed():
    sink = pa.BufferOutputStream()
    rows = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array(["a b c"])})
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    texts = pa.table({"run": [0], "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    none = pa.table({c: pa.array([], pa.binary() if c in ("times", "ends") else pa.int64()) for c in ("run", "part", "n", "mark", "times", "ends")})
    with pytest.raises(RuntimeError, match="changed"):
        backoff._scored(2, 0, 2)(texts, none)
