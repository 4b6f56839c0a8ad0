"""The training-data operators against brute force, on fixtures with every awkward case."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from clauselens.llm import bpe, chat_format, exact_dedup, language_id, license_scan, near_copies, packing, secrets, simhash, token_files, weighted_sampling
from clauselens.llm.common import components, local_roots, texts_of

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, name string, own_sha string, bucket string"


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdluü", k=rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, ...): null and empty texts, null ids, repeated rows, ties, copies, near copies, a very long text."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(0, 300)) for _ in range(40)]
    texts = [None, "", " \t\n", "a", "A", "a b c", "a  b\tc", "日本語 テキスト", "x\x0by", "\x00zero\x00"] + base + base[:12] + [b.replace(" ", "  ", 3) for b in base[:5]]
    texts += [base[3] + " tail words here", words(rng, 60_000), "no-space-" * 5000]
    out = [(i * 3 % 211, t, "en", "s", None, "x", "y", "z", "b") for i, t in enumerate(texts)]
    return [*out, out[12], out[12], (None, base[1], None, None, None, None, None, None, None), (None, None, *[None] * 7)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- exact dedup ----------------------------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, rows, weak):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup.exact_groups(docs, 16, (lambda c: F.xxhash64(c) % 11) if weak else F.xxhash64).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        g = groups[norm(r[1])]
        want[(r[0], min((x for x in g if x is not None), default=None), len(g), sha(norm(r[1])))] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_exact_copies(docs, rows, empty):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(r[1]) for r in rows})
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0


# --- components and SimHash -----------------------------------------------------------------------


def roots_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (-5, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = roots_of(edges)
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_local_roots():
    groups = np.array([0, 0, 1, 1, 1, 2])
    assert local_roots(groups, np.array([0, 3, 3, 4, 2, 5]), 6).tolist() == [0, 1, 0, 0, 0, 5]


def brute_simhash(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, rows, empty):
    got = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(simhash.fingerprints(docs)).collect())
    fp = [brute_simhash(r[1]) for r in rows]
    root = roots_of([(i, j) for i in range(len(rows)) for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 4])
    members = {}
    for i in range(len(rows)):
        members.setdefault(root[i], []).append(rows[i][0])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == Counter((rows[i][0], signed(fp[i]), min((x for x in members[root[i]] if x is not None), default=None)) for i in range(len(rows)))
    assert simhash.near_groups(simhash.fingerprints(empty)).count() == 0


@pytest.mark.parametrize("bucket_bits", [0, 3, 12, 20])
def test_balls_miss_no_link(bucket_bits):
    rng = np.random.default_rng(bucket_bits)
    bits, radius = 24, 4
    base = rng.integers(0, 1 << bits, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(m) for m in (0, 1, 6, 0x111, 0x8421, 0x1F)]))
    links = []
    _, _, classes, _, _ = simhash.ball(bits, radius // 2, bucket_bits)
    columns = simhash.ball(bits, radius // 2, bucket_bits)[0]
    buckets = np.unique(simhash.bucket_of(fps, columns)[:, None] ^ classes[None, :])
    for b in buckets.tolist():
        u, v = simhash.links_in(fps, b, bits, radius, bucket_bits)
        links += zip(u.tolist(), v.tolist(), strict=True)
    got = roots_of([*links, *((i, i) for i in range(len(fps)))])
    want = roots_of([(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius])
    part = lambda r: {frozenset(k for k in r if r[k] == x) for x in set(r.values())}
    assert part(got) == part(want)


def test_passes_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 80)
    fps = np.unique(np.concatenate([base ^ m for m in (0, 3, 0x10100)]))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp bigint")
    part = lambda links: roots_of([(r.u, r.v) for r in links.collect()] + [(int(f), int(f)) for f in fps])
    one = part(simhash.ball_links(df, len(fps)))
    monkeypatch.setattr(simhash, "PASS_BYTES", 256)
    many = part(simhash.ball_links(df, len(fps)))
    assert len(set(one.values())) == len(set(many.values())) == 80
    with pytest.raises(ValueError):
        simhash.ball_links(df, 1, radius=3)


def test_near_copies(spark, empty):
    rng = random.Random(9)
    texts, near = [], []
    for g in range(30):
        w = words(rng, 260).split()
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for k in rng.sample(range(len(v)), 4):
                v[k] = "changed" + str(rng.randint(0, 99))
            texts.append(" ".join(v))
        near.append(g * 4)
    texts += ["of the", "the of", "a", "", None, words(rng, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df).collect()}
    caught = sum(got[i] == i // 4 * 4 for i in range(120))
    assert caught >= 114
    assert got[120] == 120 and got[121] == 121 and got[122] == 122 and got[125] == 125
    assert got[123] == got[124] == 123
    assert near_copies.drop_near_copies(empty).count() == 0


# --- encoders -------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(6)
    fixed = ["", "   ", "a  b   c\n\n d", "<|endoftext|>x<|endoftext|> y", " aaaaaaaa aaaa aaa", "it's we'll 've  'S", "漢字 ²½ x² Ⅷ \x0b\x1c \x85 a", "\U0001f600‍"]
    return fixed + ["".join(rng.choice("ab c'se\n\t \xa0éß1²_-漢<|>") for _ in range(rng.randint(1, 80))) for _ in range(400)]


def test_encoders_equal_the_library(library):
    texts = odd_texts() + ["".join(random.Random(1).choices(["foo ", "bar", " baz\n", "  q"], k=400_000))]
    for coder in (bpe.PairIndexBPE(PATH), token_files.LibraryEncoder(PATH)):
        ids, n = coder.encode(texts)
        ends = np.r_[0, np.cumsum(n)]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_rows(docs, rows, library, empty):
    got = Counter(tuple(r) for r in bpe.bpe_round_trip(docs, PATH).collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    assert bpe.bpe_round_trip(empty, PATH).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_of_ids(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1003)
    assert (token_files.unpack(token_files.pack(x, bits), len(x), bits) == x).all()


def test_token_files(spark, docs, rows, library, empty):
    folder = token_files.token_folder(spark)
    files = token_files.write_token_files(docs, folder, PATH, 2)
    got = token_files.read_token_files(spark, folder, files).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for r in order:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    file = token_files.TokenFile(f"{folder}/{files[0][0]:06d}.ids")
    assert file.bits == 16 and file.document(file.n_docs - 1)[-1] == 2
    folder = token_files.token_folder(spark)
    assert token_files.read_token_files(spark, folder, token_files.write_token_files(empty, folder, PATH, 2)).count() == 0


# --- weighted sampling ----------------------------------------------------------------------------


def weighted_jaccard(a, b):
    x, y = (Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t).split()) for t in (a, b))
    return sum(min(x[k], y[k]) for k in x | y) / max(1, sum(max(x[k], y[k]) for k in x | y))


def test_collision_rate_is_weighted_jaccard(spark):
    rng = random.Random(3)
    a = words(rng, 80)
    pairs = [(a, " ".join(a.split()[: 10 * k] + words(rng, 80 - 10 * k).split())) for k in range(9)] + [("x x x y", "x y y y"), ("x " * 9, "x " * 3)]
    df = spark.createDataFrame([(i, k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "i int, which int, text string")
    n = 128
    marks = {(r.i, r.which): r.fingerprint for r in weighted_sampling.fingerprints(df, ["i", "which"], n).collect()}
    for i, (x, y) in enumerate(pairs):
        p, q = marks[i, 0], marks[i, 1]
        same = sum(p[8 * k : 8 * k + 8] == q[8 * k : 8 * k + 8] for k in range(n)) / n
        assert abs(same - weighted_jaccard(x, y)) < 0.16


def test_edited_fingerprints(docs, rows, empty, spark):
    got = weighted_sampling.edited_fingerprints(docs, 8, 6).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[(r[0], len(t), sha(t[: len(t) - half] + nxt[:half]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_text[rows[12][0]] and len(by_text[rows[12][0]]) == 1
    assert weighted_sampling.edited_fingerprints(empty).count() == 0
    one = weighted_sampling.edited_fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0


# --- packing --------------------------------------------------------------------------------------


def test_best_boundaries():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(1, 8)
        longest, count, buckets = sorted(rng.sample(range(1, 50), n)), [rng.randint(1, 5) for _ in range(n)], rng.randint(1, 4)
        pad = lambda tops: sum(c * (min(u for u in tops if u >= x) - x) for x, c in zip(longest, count, strict=True))
        best = min(pad([*(longest[i] for i in cut), longest[-1]]) for b in range(buckets) for cut in combinations(range(n - 1), min(b, n - 1)))
        bounds, padding = packing.best_boundaries(np.array(longest), np.array(count), buckets)
        assert padding == best == pad(bounds)


def test_boundaries_equal_the_quadratic_program():
    rng = np.random.default_rng(4)
    for n, buckets in ((200, 12), (61, 3), (5, 12)):
        length, count = np.sort(rng.choice(10_000, n, replace=False)) + 1, rng.integers(1, 50, n)
        c, s = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * length)]
        cost = [0] + [10**15] * n
        for _ in range(buckets):
            cost = [min([cost[j]] + [cost[i] + (c[j] - c[i]) * length[j - 1] - (s[j] - s[i]) for i in range(j)]) for j in range(n + 1)]
        bounds, padding = packing.best_boundaries(length, count, buckets)
        top = length[np.searchsorted(length, np.array(bounds)[np.searchsorted(bounds, length)])]
        assert padding == cost[n] == ((top - length) * count).sum() and len(bounds) <= buckets


def test_pack(docs, rows, empty, spark):
    got = packing.pack(docs, buckets=4, tokens=500).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1) for r in rows)
    batches = {}
    for r in got:
        assert r.length + r.padding == r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.place for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 500
    assert packing.pack(empty).count() == 0
    for b in packing.batches(packing.pack(docs, buckets=4, tokens=500)).collect():
        rows_of = sorted(batches[b.bucket, b.batch], key=lambda r: r.place)
        assert b.doc_ids == [r.doc_id for r in rows_of] and (b.docs, b.tokens, b.padding) == (len(rows_of), sum(r.length for r in rows_of), sum(r.padding for r in rows_of))


def test_ties_of_one_id_are_dealt_out(spark):
    """A third of all rows under one id, and null ids."""
    df = spark.createDataFrame([(7 if i % 3 else None, "w " * (i % 5)) for i in range(300)], "doc_id bigint, text string")
    got = packing.pack(df, buckets=2, tokens=20).collect()
    assert len(got) == 300 and len({(r.bucket, r.batch, r.place) for r in got}) == 300


# --- chat -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bit = lambda: "".join(rng.choice(["<", "|", "\\", "im_end", "<|im_start|>", ">", "a", "é", "\n"]) for _ in range(rng.randint(0, 12)))
    turns = [(c, k, rng.choice(["user", "assistant", "sys\ntem", "<|im_end|>", "a\\b", None]), None if rng.random() < 0.1 else bit()) for c in [*range(25), None] for k in range(rng.randint(1, 9))]
    turns += [turns[0], (3, None, "assistant", "no turn"), (99, 0, "user", "only asks")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string, loss_start int").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, (t[3] or "").encode())
    want = {}
    for c, g in groupby(sorted(turns, key=key), key=lambda t: t[0]):
        g = list(g)
        loss = "".join(t[3] or "" for t in g if t[2] == "assistant")
        want[c] = (len(g), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in g)), len(loss), sha(loss))
    assert {c: r[:4] for c, r in got.items()} == want
    assert all(r[4] >= r[2] for r in got.values())
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).count() == 0


# --- license --------------------------------------------------------------------------------------

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark, docs, rows, empty):
    rng = random.Random(5)
    bits = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "x", " ", "-", "\x00", "é", "under the mit license", "cc by nc cc by nc"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "-", "\n", ""]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert {k: tuple(r)[1:6] for k, r in got.items()} == {i: brute_license(t) for i, t in enumerate(texts)}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values())
    assert len(license_scan.license_scan(docs).collect()) == len(rows)
    assert license_scan.license_scan(empty).count() == 0


def test_fuzzy_notices(spark):
    texts = ["Licensed under the MIT licence.", "GNU Generl Public License", "GNU General Pubic Licence", "under the bit license", "apache license version 1", "See: creative commons attributin non-commercial é ok"]
    got = [r.labels for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got == ["mit", "", "gpl", "", "", "cc-by-nc"]


def test_accents_are_one_edit(spark):
    rows = [(0, "GNU Général Public License"), (1, "under thé mit license"), (2, "permission is héreby granted free öf chärge")]
    got = [r.spans for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got == ["", "mit:0:21:1", "mit:0:43:3"]


def test_fuzzy_search_equals_a_look_at_all_runs_of_words():
    rng = random.Random(12)
    for _ in range(60):
        words = []
        for _ in range(12):
            text = list(rng.choice(license_scan.NOTICES)[0])
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(["", "x", "é", "xy", " "])
            words += ["".join(text), rng.choice(["", "of", "mit"])]
        low, _, first = license_scan.words_of(*texts_of(pa.array([" ".join(words)])))
        raw = low.tobytes()
        got = {}
        for s, e, label, n in license_scan.search(low, first)[1]:
            got.setdefault(label, []).append((s, e, n))
        at = [m.span() for m in re.finditer(rb"[^ \x00]+", raw)]
        for text, label, k, needed, _ in license_scan.NOTICES:
            pattern = regex.compile(f"(?:{text}){{e<={k}}}", regex.BESTMATCH)
            for i, (s, _) in enumerate(at):
                for _, e in at[i:]:
                    if abs(e - s - len(text)) <= 4 * k and set(needed) <= set(raw[s:e].decode().split()) and pattern.fullmatch(raw[s:e].decode()):
                        assert any(x < e and s < y for x, y, _ in got.get(label, [])), (text, raw[s:e])
        for label, spans in got.items():
            for s, e, n in spans:
                assert any(m and sum(m.fuzzy_counts) == n for text, other, k, *_ in license_scan.NOTICES if other == label for m in [regex.compile(f"(?:{text}){{e<={k}}}", regex.BESTMATCH).fullmatch(raw[s:e].decode())])


def test_misspelt_notices_take_linear_time():
    rng = random.Random(6)
    parts, size = [], 0
    while size < 5 << 20:
        text = list(rng.choice(license_scan.NOTICES)[0])
        text[rng.randrange(len(text))] = rng.choice("abcdefgh")
        parts.append("".join(text))
        size += len(text) + 1
    low, _, first = license_scan.words_of(*texts_of(pa.array([" ".join(parts)])))
    began = time.process_time()
    _, spans = license_scan.search(low, first)
    assert time.process_time() - began < 20 and len(spans) > 50_000


def test_pigeonhole_pieces_make_up_the_notice():
    for text, _, k, _, _ in license_scan.NOTICES:
        pieces = license_scan.seeds(text, k)
        assert b"".join(p for _, p in pieces).decode() == text and len(pieces) == k + 1


# --- secrets --------------------------------------------------------------------------------------


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_spans(spark, docs, rows, empty):
    rng = random.Random(3)
    bits = ["token", "=", ": ", "'", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "é", "ſecret", "secret", "API_KEY", "apikey", "\n", " ", "xYz09+/=", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in secrets.scan(df).collect():
        want = brute_secrets(texts[r.doc_id])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(x[1] == k for x in want) for k in range(3)), sha(said))
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("random")) == said
    assert len(secrets.scan(docs).collect()) == len(rows)
    assert secrets.scan(empty).count() == 0


def test_random_strings_against_identifiers():
    models = secrets.trained()
    strings, names = secrets.labelled_samples(2000, seed=77)
    hit = np.mean([models.score(s.encode()) > models.threshold for s in strings if len(s) >= 20])
    false = np.mean([models.score(s.encode()) > models.threshold for s in names if len(s) >= 20])
    assert hit > 0.97 and false < 0.005


def test_redact(spark, docs, rows, empty):
    key = "AKIA" + "ABCDEFGH12345678"
    df = spark.createDataFrame([(1, f"é key {key} end", 5), (2, None, None), (3, "plain", 5)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df).collect()}
    assert got == {1: ("é key <access> end", 18), 2: (None, None), 3: ("plain", 5)}
    assert secrets.redact(docs).count() == len(rows) and secrets.redact(empty).count() == 0


@pytest.mark.parametrize("least", [2, 5, 16])
def test_runs(least):
    rng = np.random.default_rng(least)
    member = rng.random(5000) < 0.85
    raw = "".join("x" if m else "." for m in member)
    a, b = secrets.runs(member, least)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [m.span() for m in re.finditer("x+", raw) if len(m[0]) >= least]


# --- language -------------------------------------------------------------------------------------

SYLLABLES = {"aa": "ka lo mi ru te".split(), "bb": "sch ung eit ver zu".split(), "cc": "tion que eau oux ent".split()}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def models():
    rng = random.Random(8)
    return language_id.fit({x: [tongue(rng, x, 80) for _ in range(60)] for x in SYLLABLES})


def test_held_out_accuracy_and_rejection(models, spark):
    rng = random.Random(18)
    texts = [(x, tongue(rng, x, rng.randint(3, 200))) for x in SYLLABLES for _ in range(60)]
    odd = [None, "", "12 34 !?", "qzxjkvwq xkqjz qqzzxx wvkjq zxqwk", "漢字" * 30]
    df = spark.createDataFrame([(i, t, "cc", "z") for i, t in enumerate([t for _, t in texts] + odd)], "doc_id bigint, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df, models).collect()}
    n = len(texts)
    assert np.mean([got[i].lang_pred == texts[i][0] for i in range(n)]) > 0.99
    assert not any(got[i].rejected for i in range(n))
    assert [got[n + k].lang_pred for k in range(3)] == ["und"] * 3 and [got[n + k].score for k in range(3)] == [0, 0, 0]
    assert all(got[n + k].rejected for k in range(5))
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_identified(df, models)
    assert kept.columns == df.columns and kept.count() == n
    assert language_id.identify(df.limit(0), models).count() == 0
    nothing = language_id.fit({})
    assert {r.lang_pred for r in language_id.identify(df.limit(5), nothing).collect()} == {"und"}


def test_probabilities_sum_to_one(models):
    code, scored, _ = language_id.stream(*texts_of(pa.array(["ka lo schung"])))
    letters = sorted({*"abcdefghijklmnopqrstuvwxyz "})
    for cut in (6, 9, len(code) - 1):
        total = np.zeros(3)
        for c in letters:
            probe = code[: cut + 1].copy()
            probe[cut] = ord(c)
            mask = np.zeros(cut + 1, bool)
            mask[cut] = True
            total += np.exp(models.log_probabilities(probe, mask)[0])
        assert (total < 1.001).all() and (total > 0.8).all()


def test_predictions_don_t_depend_on_neighbours(models):
    rng = random.Random(1)
    texts = [tongue(rng, x, 20) for x in SYLLABLES]
    alone = np.concatenate([models.score(*texts_of(pa.array([t])))[0] for t in texts])
    assert np.allclose(alone, models.score(*texts_of(pa.array(texts)))[0], atol=1e-3)


def test_labelled_sample(docs, spark):
    many = spark.createDataFrame([(i, f"text {i}", "en" if i % 3 else None) for i in range(900)], "doc_id bigint, text string, lang string")
    got = language_id.labelled_sample(many, 100)
    assert set(got) == {"en"} and 60 < len(got["en"]) < 150
    assert language_id.labelled_sample(docs)["en"]


def test_long_text_is_scored_whole(models, monkeypatch):
    """Scores don't depend on the number of characters that are scored at a time, spaces or not."""
    rng = random.Random(2)
    long = tongue(rng, "bb", 60_000)
    texts = [long, "ka lo mi", long.replace(" ", "\n"), long.replace(" ", ""), "", "é" * 1000]
    want, n = models.score(*texts_of(pa.array(texts)))
    assert abs(int(n[0]) - len(long)) < 20 and n[4] == 0
    for places in (1000, 4099):
        monkeypatch.setattr(language_id, "PLACES", places)
        got, m = models.score(*texts_of(pa.array(texts)))
        assert np.allclose(got, want, rtol=1e-12) and (m == n).all()
    best, _, rejected, _ = language_id._judged(models, *texts_of(pa.array(texts)))
    assert [models.languages[b] for b in best[:3]] == ["bb", "aa", "bb"] and not rejected[0]


def test_bits_for_similarity():
    assert 35 < near_copies.most_bits(0.8) < 50 and near_copies.most_bits(0.99) < 20 and math.isclose(simhash.bucket_bits_for(1, 64, 2), 7)
