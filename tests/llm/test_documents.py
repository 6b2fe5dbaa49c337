"""Language ID, SimHash groups, chat formatting and mixing on small tables, against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import chat, langid, mixing, simhash
from lodestar.llm.store import Scratch

LANGUAGES = {
    "en": "the and of to that with this from have their would there been which when will people could other about",
    "de": "der die und das nicht mit sich auch eine werden einer haben sein wurde durch zwischen gegen schon immer",
    "fr": "les des une dans pour que qui est pas plus avec sont cette tout mais comme leur aussi entre depuis encore",
}


def sentences(lang, n, seed):
    rnd = random.Random(f"{lang}{seed}")
    return [" ".join(rnd.choices(LANGUAGES[lang].split(), k=rnd.randint(5, 30))) for _ in range(n)]


# Language ID


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(n, t, lang) for lang in LANGUAGES for n, t in enumerate(sentences(lang, 200, 1), 1000 * len(lang + LANGUAGES[lang]))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_of_held_out_rows(labelled):
    filters = langid.fit_documents(labelled)
    got = langid.identified(labelled, filters).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert all(0.5 < r["score"] <= 1 for r in got)


def test_popcounts_equal_single_lookups(labelled):
    """The bit-sliced look-up of a batch, against one n-gram and one language at a time."""
    filters = langid.fit_documents(labelled)
    text = "The people, und nicht — les 42 x"
    found, total = filters.counts([None, text, ""])
    points = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    n_all, n_found = 0, [0] * len(filters.languages)
    for n in langid.LENGTHS:
        for at in range(len(points) - n + 1):
            if all(points[at + 1 : at + n - 1]):
                n_all += 1
                h, _ = langid._grams(np.array(points[at : at + n]), n)
                slots = [int(filters.slots[0, s[0]]) for s in langid._slots(h)]
                for k in range(len(filters.languages)):
                    n_found[k] += all(x >> k & 1 for x in slots)
    assert total.tolist() == [0, n_all, 0] and found[1].tolist() == n_found and not found[0].any()


def test_more_languages_than_a_mask_has_bits(spark):
    rnd = random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rnd.choices(alphabet, k=5)) for _ in range(12)] for k in range(70)}
    rows = [(n * 70 + k, " ".join(rnd.choices(words[lang], k=25)), lang) for k, lang in enumerate(words) for n in range(8)]
    filters = langid.fit_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(filters.languages) == 70 and filters.slots.shape[0] == 2
    names, _ = filters.predict([" ".join(rnd.choices(words[x], k=20)) for x in words])
    assert sum(a == b for a, b in zip(names, words, strict=True)) >= 68


def test_long_texts_are_counted_whole(labelled, monkeypatch):
    filters = langid.fit_documents(labelled)
    text = " ".join(sentences("en", 50, 2) + sentences("de", 60, 2))
    whole = filters.counts([text, "und"])
    monkeypatch.setattr(langid, "STEP", 97)
    parts = filters.counts([text, "und"])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language_of_awkward_rows(docs, labelled):
    filters = langid.fit_documents(labelled)
    got = langid.identified(docs, filters).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = r["text"] is not None and any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and r["row_hash"] == "clash"
    assert langid.identified(docs.limit(0), filters).collect() == []
    nothing = langid.fit_documents(labelled.limit(0))
    assert {r["lang_pred"] for r in langid.identified(docs, nothing).collect()} == {"und"}


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = Counter(j for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for j in range(64) if h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * ones[j] > len(shingles))


def plain_components(fps):
    """Least index of each fingerprint's component, all pairs compared."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(fps))]


def test_golay_keys_of_words_at_distance_one_meet():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 3000)
    index = simhash.codeword_index(words)
    for bit in range(23):
        near = simhash.codeword_index(words[:, None] ^ np.array([0, *(1 << b for b in range(23))]))
        assert (near == simhash.codeword_index(words ^ (1 << bit))[:, None]).any(axis=1).all()
    # 4096 codewords; a word within three bits of a codeword decodes to it
    assert len(np.unique(simhash.codeword_index(np.arange(1 << 16) << 7))) <= 4096
    code = words ^ simhash._golay()[1][0]
    assert (index == simhash.codeword_index(code)).all()


def test_bucket_keys_lose_no_pair():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, dtype=np.uint64)
    bits = rng.integers(0, 64, (2, 2000)).astype(np.uint64)
    b = a ^ (np.uint64(1) << bits[0]) ^ (np.uint64(1) << bits[1])
    keys = [simhash.bucket_keys(x.view(np.int64)) for x in (a, b)]

    def by(k, searching):
        out = defaultdict(set)
        for key, at, s in zip(*k, strict=True):
            if s == searching:
                out[at].add(key)
        return out

    stored, asked = by(keys[0], False), by(keys[1], True)
    assert all(stored[k] & asked[k] for k in range(2000))


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_components_of_planted_fingerprints(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(7)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):  # chains whose ends are far apart, stars, and lone ones
        x = rnd.getrandbits(64)
        fps.append(x)
        for _ in range(rnd.choice([0, 0, 3, 12])):
            fps.append(fps[-1] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = sorted(set(fps))
    want = plain_components(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    scratch = Scratch(spark, "test")
    distinct = scratch.write(spark.createDataFrame([(x,) for x in signed], "fp bigint"), "fps")

    if bucket_rows == 3:  # the patched limit has to reach the workers
        links = simhash._ball_links(distinct.select(distinct["fp"].alias("a")))
    else:
        links = simhash.links(distinct, scratch)
    nodes = {r["node"]: r["root"] for r in simhash.components(links, scratch).collect()}
    groups = defaultdict(set)
    for x in signed:
        groups[nodes.get(x, x)].add(x)
    expected = defaultdict(set)
    for x, w in zip(signed, want, strict=True):
        expected[w].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("bucket_rows, busy_share", [(3, 1.0), (3, 1 / 50), (20, 1 / 1000)])
def test_hot_buckets_end_to_end(spark, monkeypatch, bucket_rows, busy_share):
    """Fingerprints of which many share a segment: buckets are told before the shuffle, or found overfull in their task."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(simhash, "BUSY_SHARE", busy_share)
    monkeypatch.setattr(simhash, "FEW_EDGES", 0)
    rnd = random.Random(8)
    low = rnd.getrandbits(43)
    fps = sorted({low | rnd.getrandbits(9) << 43 for _ in range(150)} | {rnd.getrandbits(64) for _ in range(100)} | {(1 << 63) | (1 << k) for k in range(40)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    scratch = Scratch(spark, "test")
    distinct = scratch.write(spark.createDataFrame([(x,) for x in signed], "fp bigint").repartition(3), "fps")
    assert bool(len(simhash.busy_keys(distinct))) == (busy_share < 1)
    nodes = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, scratch), scratch).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for x, w in zip(signed, plain_components(fps), strict=True):
        got[nodes.get(x, x)].add(x)
        want[w].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_overfull_buckets_hand_on_their_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 4)
    import pyarrow as pa

    keys, fp = [1] * 3 + [2] * 9 + [3], list(range(100, 113))
    batches = [pa.record_batch({"key": keys[s:e], "fp": fp[s:e], "searching": [k % 2 == 0 for k in range(s, e)]}) for s, e in ((0, 2), (2, 6), (6, 13))]
    rows = [r for b in simhash._links_of_sorted(batches) for r in b.to_pylist()]
    assert {r["a"] for r in rows if r["b"] is None} == set(range(103, 112))


def test_linked_rows(docs):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.linked(docs).collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    component = plain_components(fps)
    least = defaultdict(list)
    for r, c in zip(rows, component, strict=True):
        if r["doc_id"] is not None:
            least[c].append(r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", min(least[c], default=None)) for r, f, c in zip(rows, fps, component, strict=True))
    assert Counter((g["doc_id"], g["fingerprint"], g["component_id"]) for g in got) == want
    assert simhash.linked(docs.limit(0)).collect() == []


def test_deduplicated_rows(docs):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    best = {r["component_id"] for r in simhash.linked(docs).collect()}
    assert set(ids) == best and set(ids.values()) == {1}  # with the one component that has no id at all


def test_repeated_ids_with_different_texts(spark):
    """Each component keeps one row, whatever else has its smallest id."""
    a, b, c = ("The quick brown fox jumps over the lazy dog", "Rain fell on the harbour all through the night", "A third text that has nothing to do with them")
    table = spark.createDataFrame([(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (5, b, 5), (9, c, 6), (9, "", 7), (9, None, 8), (10, c, 9)], "doc_id bigint, text string, root int").repartition(3)
    kept = simhash.deduplicated(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(3, a), (5, b), (9, c), (9, "")])


# Chat


def test_formatted_conversations(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "user", "[INST] \\ </s> <s>"), (1, 3, "assistant", ""), (1, 4, "assistant", "a [SEP] b\\"), (1, 200, "assistant", "later"), (1, 201, "user", None),
        (2, 5, "tool", "x"), (2, 5, "tool", "x"), (2, 6, "a[SAYS]b", "[/ROLE]"), (2, 7, None, "no role"),
        (None, None, "user", "é\U0001f600"), (None, None, "assistant", "null turn"), (None, 1, "assistant", "ok"),
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    rows += [(9, k, "assistant", f"turn {k} <") for k in range(300)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string").repartition(4)
    out = chat.formatted(table)
    texts = {r["conv_id"]: r for r in out.select("conv_id", chat.text_of(out["segments"]).alias("text"), "segments").collect()}
    assert texts[1]["text"].startswith("<s>[SYS]be kind[/SYS][INST]hi[SEP][\\INST] \\\\ <\\/s> <\\s>[/INST][ASST][SEP]a [\\SEP] b\\\\[SEP]later</s>[INST][/INST]")
    assert texts[9]["text"].count("[SEP]") == 299 and texts[9]["text"].count("[ASST]") == 1
    plain = lambda t: re.sub(r"([\[<\\])\\", r"\1", t)
    for conv, r in texts.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        spans = [plain(s["text"][m["start"] : m["start"] + m["length"]]) for s in r["segments"] for m in s["loss"]]
        assert spans == [x[3] or "" for x in turns if x[2] == "assistant"]
    digests = {r["conv_id"]: r for r in chat.digests(out).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in (1, 2, 9, -7):
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        d = digests[conv]
        assert (d["n_turns"], d["turns_sha256"]) == (len(turns), sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)))
        assert (d["loss_chars"], d["loss_sha256"], d["formatted_chars"]) == (len(loss), sha(loss), len(texts[conv]["text"]))
    assert digests[None]["n_turns"] == 3
    assert chat.digests(chat.formatted(table.limit(0))).collect() == []


# Mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    return target


def test_targets(spark):
    rnd = random.Random(3)
    for _ in range(4):
        sizes = {s: rnd.choice([0, 1, 5, 5, 200, 3000]) for s in ["b", "a", "é", "Z", None, "", "zz"]}
        rows = [(s, n) for s, total in sizes.items() for n in (total // 3, total - total // 3)]
        got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
        for s, t in plain_targets(sizes).items():
            assert got[s]["target"] == pytest.approx(t, abs=1e-9) and got[s]["source_size"] == sizes[s]


def test_words_taken_meet_targets(spark):
    rnd = random.Random(4)
    rows = [(k, "w " * rnd.choice([0, 1, 3, 40, 900]), rnd.choice("aaaaaabc")) for k in range(3000)] + [(5000, "same row twice", "d")] * 700
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixed(table.repartition(3)).collect()
    assert len(got) == len(rows)
    source = {k: s for k, _, s in rows}
    taken, targets = Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    partial = Counter(source[r["doc_id"]] for r in got if r["size"] and r["taken"] % r["size"])
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets) and max(partial.values(), default=0) <= 1
    again = mixing.mixed(table.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    sample = mixing.sampled(table).groupBy("source").agg({"text": "count"}).collect()
    words = Counter()
    for r in mixing.sampled(table).collect():
        words[r["source"]] += len(r["text"].split())
    assert len(sample) == 4 and words == taken


def test_expected_copies_are_kept(spark):
    """Over many documents the share that is taken is that of the target, for small and large ones alike."""
    rows = [(k, "w " * (2 if k % 2 else 50), "a" if k % 5 else "b") for k in range(4000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for size in (2, 50):
        some = [r for r in got if r["size"] == size and r["doc_id"] % 5]
        share = some[0]["target"] / some[0]["source_size"]
        assert np.mean([r["taken"] / r["size"] for r in some]) == pytest.approx(share, abs=0.05)


def test_whole_texts_of_the_mix(spark):
    rows = [(k, " ".join(f"w{k}x{n}" for n in range(20)), f"s{k}") for k in range(300)] + [(300 + k, "v " * 19 + f"v{k}", "large") for k in range(20)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    texts = {k: t for k, t, _ in rows}
    got = mixing.sampled(table, whole=True).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in got)
    counts = Counter(r["doc_id"] for r in got)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(table).collect()}
    cut = [k for k, n in taken.items() if n % 20]
    assert len(cut) > 100 and all(taken[k] // 20 <= counts[k] <= -(-taken[k] // 20) for k in texts)
    # Within four standard deviations at most.
    assert sum(counts[k] * 20 for k in cut) == pytest.approx(sum(taken[k] for k in cut), abs=4 * 10 * len(cut) ** 0.5)


def test_mix_of_awkward_rows(docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(t, 6)) for s, t in plain_targets(sizes).items()}
    assert mixing.sampled(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).collect() == [] and mixing.sampled(docs.limit(0)).collect() == []


# Mixing against a plain rounding and against SQL


def spark_hash(*values):
    """XXH64 of values, each seeded with the hash of those before: strings as UTF-8, numbers as 8 bytes, or 4 if marked as short."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_mix(rows, shares, chunk_size):
    """Words taken of rows ``(doc_id, text, source)``, one pair after the other, given sizes and targets of the sources."""
    taken = Counter()
    by_source = defaultdict(list)
    for n, (doc, text, source) in enumerate(rows):
        size, row = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), spark_hash(doc, text)
        number = 1 + sum(r == (doc, text, source) for r in rows[:n])
        by_source[source].append((spark_hash(row, source, number), doc, row, size))
    most = max(-(-len(x) // chunk_size) for x in by_source.values())

    def rounded(items, level):
        rest, done = None, []
        for order, key, size, mass in sorted(items):
            if rest is None:
                rest = [order, key, size, mass]
                continue
            there, back = min(rest[3], size - mass), min(mass, rest[2] - rest[3])
            u = (spark_hash(rest[0], order, rest[1], key, (level,)) % (1 << 53)) / (1 << 53)
            if moves := u * (there + back) < back:
                a, b, settles = rest[3] - there, mass + there, rest[3] <= size - mass
            else:
                a, b, settles = rest[3] + back, mass - back, rest[2] - rest[3] <= mass
            if settles:
                done.append((rest[1], 0 if moves else rest[2]))
                rest = [order, key, size, b]
            else:
                done.append((key, size if moves else 0))
                rest[3] = a
        return done, rest

    for source, members in by_source.items():
        size, target = shares[source]
        copies = target / size if size else 0.0
        chunks = -(-len(members) // chunk_size)
        dealt = defaultdict(list)
        for m in members:
            dealt[spark_hash(m[0], (0,)) % chunks].append(m)
        open_, words = [], {}
        for c, ms in dealt.items():
            ms.sort()
            items = [(m[0], k, m[3], (copies - int(copies)) * m[3]) for k, m in enumerate(ms)]
            for k, m in enumerate(ms):
                words[c, k] = int(copies) * m[3]
            done, rest = rounded([x for x in items if 0 < x[3] < x[2]], 0)
            for k, w in done:
                words[c, k] += w
            if rest:
                open_.append((c, rest))
        place = {c: rest[1] for c, rest in open_}
        items, level, left = [(r[0], c, r[2], r[3]) for c, r in open_], 0, most
        while left > 1:
            level, left = level + 1, -(-left // chunk_size)
            groups = defaultdict(list)
            for x in items:
                groups[x[1] // chunk_size**level].append(x)
            items = []
            for g in groups.values():
                done, rest = rounded(g, level)
                for c, w in done:
                    words[c, place[c]] += w
                items.append(tuple(rest))
        for x in items:
            words[x[1], place[x[1]]] += int(x[3] + 0.5)
        for (c, k), w in words.items():
            taken[dealt[c][k][1], dealt[c][k][3], w] += 1
    return taken


@pytest.mark.parametrize("chunk_size", [3, 64])
def test_pivots_equal_a_plain_rounding(spark, monkeypatch, chunk_size):
    monkeypatch.setattr(mixing, "CHUNK", chunk_size)
    monkeypatch.setattr(mixing, "ALIKE", 4)
    rnd = random.Random(11)
    rows = [(k, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(["a", "a", "a", "b", "c", None])) for k in range(160)]
    rows += [(None, None, "b"), (None, "x y z", None)] + [(500, "a row and its copies", "a")] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mixed(docs).collect()
    sources = {doc: source for doc, _, source in rows if doc is not None}
    shares = {sources[r["doc_id"]]: (r["source_size"], r["target"]) for r in got if r["doc_id"] is not None}
    assert len(shares) == 4
    want = plain_mix(rows, shares, chunk_size)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == want


TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
p AS (SELECT source, sum(size) AS source_size, 2 * sum(size) AS room, list_element([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM p WINDOW w AS (ORDER BY room / weight, source)),
f AS (SELECT arg_min(level, room / weight) AS level FROM l WHERE room / weight >= level)
SELECT doc_id, size, source_size, round(least(room, f.level * weight), 6) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, f
"""


def test_sizes_and_targets_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    want = con.execute(TARGETS).fetchall()
    assert sorted((r["doc_id"], r["size"], r["source_size"]) for r in got) == sorted(r[:3] for r in want)
    targets = {r[0]: r[3] for r in want}
    assert all(r["target"] == pytest.approx(targets[r["doc_id"]], rel=1e-9) for r in got)


# Crowded turns


def test_turns_that_share_a_number(spark, monkeypatch):
    """Many rows of one turn, alike and different, without a number and with clashing neighbours, against a plain template."""
    monkeypatch.setattr(chat, "CROWD", 10)
    rnd = random.Random(12)
    rows = [(1, 5, "user", "again")] * 300 + [(1, 5, "assistant", f"[{rnd.random()}")  for _ in range(90)] + [(1, k, rnd.choice(["user", "assistant"]), f"t{k}") for k in range(70)]
    rows += [(2, None, rnd.choice(["user", "assistant", "judge"]), rnd.choice(["a", "b", None])) for _ in range(40)] + [(2, 3, "user", "last")] + [(3, 0, "user", "x"), (None, None, None, None)]
    rnd.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    read = chat.formatted(turns).select("conv_id", chat.text_of(F.col("segments")).alias("text"), chat.loss_texts(F.col("segments")).alias("loss"), chat.turns_of(chat.text_of(F.col("segments"))).alias("turns"))
    got = {r["conv_id"]: r for r in read.collect()}
    assert sorted(got, key=str) == [1, 2, 3, None]
    for conv, r in got.items():
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in own]
        assert r["loss"] == [x[3] for x in own if x[2] == "assistant"]
    monkeypatch.setattr(chat, "CROWD", 4096)
    assert {r["conv_id"]: r["text"] for r in chat.formatted(turns).select("conv_id", chat.text_of(F.col("segments")).alias("text")).collect()} == {c: r["text"] for c, r in got.items()}
