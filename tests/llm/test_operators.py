"""The ten operators against brute force, the libraries and their laws, on small tables with every odd case."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import byte_bpe, components, decontaminate, embedding_dedup, minhash_dedup, packing, pieces, pii, quality, queries, sharding, shared, substring_dedup, token_counts, url_filter

from ..conftest import SF
from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, high int, n string"


def documents(spark, rows):
    """Rows (doc_id, text) with the usual columns and extra ones whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1, None) for i, t in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(400), text(70)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "Word"), (4, "word"), (5, base), (6, base), (7, base + " end"), (8, text(3000)), (9, passage), (10, text(20) + "\n" + passage + "  " + text(30))]
    for i in range(11, 60):
        words = base.split()
        for _ in range(rng.randint(1, 40)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, text(rng.randint(1, 120)) + (" " + passage if i % 3 == 0 else "")) for i in range(60, 120)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(3)


def empty(spark):
    return documents(spark, [])


def test_sharding(spark, docs, rows):
    tree, manifest = sharding.kd_shards(docs, 7)
    found = manifest.collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes = {}
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes.setdefault(r.shard, []).append((r.slot, r.size))
    assert sorted(sizes) == list(range(7))
    for own in sizes.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    totals = [sum(n for _, n in own) for own in sizes.values()]
    assert max(totals) - min(totals) <= 2 * max(r.size for r in found)
    placed = sharding.with_shard(docs, tree)
    assert placed.columns == [*docs.columns, "shard"]
    assert {r.doc_id: r.shard for r in placed.collect()} == {r.doc_id: r.shard for r in found}
    assert sharding.kd_shards(empty(spark), 4)[1].count() == 0
    same = documents(spark, [(1, "a")] * 5 + [(None, "b")])
    assert sharding.kd_shards(same, 3)[1].count() == 6


def test_sharding_is_the_plain_tree(spark, monkeypatch):
    """Shard by shard the same as a K-d tree over a list; equal texts stay together, a large group and a very long text are dealt."""
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    rng = random.Random(3)
    rows = [(i, f"text {i} " + "x" * rng.randrange(300)) for i in range(400)] + [(400 + i, f"copied {i % 20} " + "y" * 9) for i in range(60)]
    rows += [(500 + i, "hot " * 8) for i in range(200)] + [(None, "n"), (None, None), (701, ""), (702, "z" * 15_000), (703, "twice"), (703, "twice")]
    docs = documents(spark, rows)
    tree, manifest = sharding.kd_shards(docs, 6)
    found = manifest.collect()
    shards = defaultdict(set)
    for r in found:
        shards[r.text_crc32, r.size].add(r.shard)
    copied = {(zlib.crc32(t.encode()), len(t.encode()) + 16) for _, t in rows[400:460]}
    assert all(len(shards[c]) == 1 for c in copied) and len(shards[zlib.crc32(b""), 16]) == 1 and len(shards[zlib.crc32(b"hot " * 8), 48]) > 1

    table = sharding._keyed(sharding._gathered(sharding._light(docs, tree.dimensions, "doc_id", "text"), tree.copies, 4), tree.scales).collect()
    names = [f"_k{i}" for i in range(4)]

    def grown(points, shards, node=1):
        if shards == 1:
            return {id(p): node for p in points}
        dim = max(range(4), key=lambda i: (max(p[names[i]] for p in points) - min(p[names[i]] for p in points), -i))
        ordered = sorted(points, key=lambda p: p[names[dim]])
        goal, left, cut = sum(p["size"] for p in points) * (shards // 2) / shards, 0, 0
        edges = [i for i in range(len(ordered) + 1) if i in (0, len(ordered)) or ordered[i - 1][names[dim]] != ordered[i][names[dim]]]
        sums = {0: 0}
        for i, p in enumerate(ordered, 1):
            left += p["size"]
            sums[i] = left
        cut = min(edges, key=lambda i: (abs(sums[i] - goal), -i))
        return grown(ordered[:cut], shards // 2, 2 * node) | grown(ordered[cut:], shards - shards // 2, 2 * node + 1)

    plain = grown(table, 6)
    depth = max(n.bit_length() for n in plain.values())
    order = {n: i for i, n in enumerate(sorted(set(plain.values()), key=lambda n: n << (depth - n.bit_length())))}
    mine = {(r["id"], r["size"], r["text_crc32"]): order[plain[id(r)]] for r in table}
    assert {(r.doc_id, r["size"], r.text_crc32): r.shard for r in found} == mine


def test_sharding_target_bytes(docs):
    tree, _ = sharding.kd_shards(docs, target_bytes=20_000)
    assert tree.shards > 3


def test_pii_base_is_exact():
    email, ip = pii.re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), pii.re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = pii.re.compile(r"[0-9]([\x20-]?[0-9])+"), pii.re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: "".join(c for c in s if c in "0123456789")

    def plain(text):
        found = [("email", *m.span()) for m in email.finditer(text)]
        found += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in card.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        found += [("phone", *m.span()) for m in phone.finditer(text) if 10 <= len(digits(m[0])) <= 15]
        return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice("0123456789.. --+()@@ab@_%é٣\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)


def test_pii(spark):
    texts = [None, "", "mail a.b@c.org or +1 (612) 555-5827", "see 71.129.171.132 4815819516090933 now", "1999-12-31 plain words, room 12", "x" * 100_000 + "@"]
    rows = list(enumerate(texts)) + [(2, texts[2])]
    found = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    assert (found[0].n_email, found[0].spans, found[0].base_sha256) == (0, "", brute.sha(""))
    assert found[2].spans == "email:5:14,phone:18:35" and found[2].base_sha256 == brute.sha(found[2].spans)
    assert found[3].spans == "ip:4:18" and found[3].n_card == 0  # the number fails its check sum
    assert found[4].spans == "" and found[5].spans == ""
    clean = {r.doc_id: r for r in pii.redacted(documents(spark, rows)).collect()}
    assert clean[2].text == "mail [EMAIL] or [PHONE]" and clean[2].n_chars == len(clean[2].text) and clean[0].text is None
    assert clean[4].text == texts[4]
    assert pii.personal_data(empty(spark)).count() == 0


def test_pii_field_is_exact():
    """Normaliser, marginals and the best segmentation against all segmentations of short texts."""
    rng = np.random.default_rng(5)
    for text, base in (("a 1234567 (12) 555", []), ("x@y.z 1234567,7", []), ("55 1234567 b@c 7", [("phone", 3, 10)]), ("1234567 1234567", [("ip", 0, 7), ("card", 3, 7)])):
        lattice = pii.Lattice(text, base)
        scores, turn = rng.standard_normal((len(lattice.segments), 4)), rng.standard_normal((5, 4))
        paths = []

        def walk(at, history, total, taken, moves):
            if at == len(lattice.tokens):
                paths.append((total, taken, moves))
                return
            for i, j, kind in lattice.fixed:
                if i == at:
                    walk(j, kind, total, taken, moves)
                    return
            walk(at + 1, history if lattice.keeps[at] else 4, total, taken, moves)
            for s, (i, j) in enumerate(lattice.segments):
                if i == at:
                    for k in range(4):
                        walk(j, k, total + scores[s, k] + turn[history, k], (*taken, (s, k)), (*moves, (history, k)))

        walk(0, 4, 0.0, (), ())
        z = np.logaddexp.reduce([p[0] for p in paths])
        other = pii.Lattice("7 x")
        (total, _), marginal, moves = pii.expected(pii.Batch([lattice, other]), scores, turn)
        assert np.isclose(total, z)
        seen, turned = np.zeros_like(scores), np.zeros_like(turn)
        for value, taken, steps in paths:
            for s, k in taken:
                seen[s, k] += np.exp(value - z)
            for h, k in steps:
                turned[h, k] += np.exp(value - z)
        assert np.allclose(marginal, seen) and np.allclose(moves, turned)
        best = max(paths, key=lambda p: p[0])
        assert pii.decoded(lattice, scores, turn) == [(*lattice.segments[s], k) for s, k in best[1]]


def test_pii_regions_are_the_whole_text():
    """Decoding the regions is decoding the text; candidates exist nowhere else."""
    rng, field = random.Random(4), pii.trained()
    parts = ["4111 1111 1111 1111", "+1 612 555 5827", "(612) 555-5828", "a.b@c.org", "x (at) y (dot) com", "10.0.0.1", "word", "é", "-" * 70, " " * 80, "q" * 90, "7" * 80, "12", ", ", ". ", "\n"]
    for _ in range(150):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14)))
        base = pii.base_spans(text)
        lattice = pii.Lattice(text, base)
        scores = np.einsum("skf,kf->sk", lattice.features(), field[0]) - pii.MARGIN
        whole = [(pii.KINDS[k], lattice.tokens[i][0], lattice.tokens[j - 1][1]) for i, j, k in pii.decoded(lattice, scores, field[1])]
        assert pii.added_spans(text, base, field) == whole


def test_pii_recall():
    """Held-out windows of another writer: recall of each kind, and numbers that are no personal data."""
    rng, field = random.Random(12), pii.trained()
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(mark):
        body = "4" + n(14)
        number = next(body + c for c in "0123456789" if pii.luhn(body + c))
        return mark.join(number[i : i + 4] for i in range(0, 16, 4))

    made = {
        "email": lambda: rng.choice([f"Jo.{n(2)}@firm-{n(1)}.example.org", "ann [at] host [dot] net", "kim (at) mail (dot) com"]),
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": lambda: card(rng.choice(["", " ", "-", ".", "/"])),
        "phone": lambda: rng.choice([f"+1 ({n(3)}) {n(3)}-{n(4)}", f"+44 {n(3)} {n(3)} {n(4)}", f"({n(3)}) {n(3)}-{n(4)}"]),
    }
    others = ["released 2021-03-04 in 12 parts", "isbn 978 3 16 148410", "in 1999, 2003 and 2007", f"sum 1,204,{n(3)}.50", "token = \"ede43f42c939b6405768150e0411590525cf889e\"", "at 10:20:30 on 04/05/2011"]
    right, total, wrong = Counter(), Counter(), 0
    for _ in range(400):
        kind = rng.choice(list(made))
        body = made[kind]()
        before = rng.choice(["Please write to ", "seen near ", f"{made['phone']()} ", "the number is: ", "(", ""])
        text = before + body + rng.choice([" and more", ", then", ".", "\n"])
        total[kind] += 1
        right[kind] += (kind, len(before), len(before) + len(body)) in pii._found(text, field)[1]
        wrong += len(pii._found(f"It was {rng.choice(others)} there", field)[1])
    recall = {k: right[k] / total[k] for k in total}
    assert min(recall.values()) >= 0.9 and wrong <= 8, (recall, wrong)


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(token_counts.default_vocabulary())
    more = rows + [(900, "a <|startoftext|>b<|endoftext|>"), (901, "x" * 30_000), (None, "n"), (901, "x" * 30_000)]
    for r in token_counts.token_counts(documents(spark, more)).collect():
        text = dict(more)[r.doc_id] or ""
        n = len(encoder.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_pieces_and_ranks_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    lib, wlib = Tokenizer.from_file(byte), Tokenizer.from_file(word)
    by_ranks, by_pieces, counts = byte_bpe.encoder(byte), byte_bpe._by_pieces(byte), pieces.cache_for(word, "count")
    rng, signs = random.Random(1), " \t\n\r\x0b\x1c\x85\xa0  　'aAsdéΣσ́ßİ12².,!<|中😀\x00"
    for _ in range(3000):
        text = "".join(rng.choice(["<|endoftext|>", "'s", "'LL", "  "]) if rng.random() < 0.07 else rng.choice(signs) for _ in range(rng.randint(0, 40)))
        ids = np.array(lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert by_ranks([text]) == by_pieces([text]) == [ids]
        cut = pieces.without_space(text)
        counts.fill(cut)
        assert sum(counts[p] for p in cut) == len(wlib.encode(text, add_special_tokens=False).ids)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    clump = base[0] + 0.04 * rng.standard_normal((40, 16))
    vectors = [v.astype(np.float32) for v in np.vstack([base, clump, base[:5], base[5:15] * 3 + 0.01 * rng.standard_normal((10, 16))])]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 0), (904, [None] * 16, 0), (905, vectors[0].tolist(), None), (906, [1.0, 2.0], 0), (None, vectors[0].tolist(), 0)]
    schema = "vec_id long, embedding array<float>, label int"
    found = {r.vec_id: r for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows + odd, schema)).collect()}
    x = np.array([v for _, v, _ in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([b for _, _, b in rows])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    top = brute.components(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    for i in range(len(rows)):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (near[i].sum() - 1, top[i], top[i] == i)
    for i in range(900, 907):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert len(found) == len(rows) + len(odd)
    assert embedding_dedup.near_embeddings(spark.createDataFrame([], schema)).count() == 0


def test_embedding_clashes_and_long_vectors(spark):
    """Columns named as those inside, double precision, vectors of 500 components, repeated ids and rows."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 500))
    vectors = np.vstack([base, base[:4] + 0.05 * rng.standard_normal((4, 500)), base[:2]])
    rows = [(i, x.tolist(), "a", 1, "n", b"v") for i, x in enumerate(vectors)] + [(3, vectors[3].tolist(), "a", 1, "n", b"v")]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string, sub int, node string, vector binary")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_embeddings(table).collect())
    near = {i: [j for j, (_, y, *_) in enumerate(rows) if j != i and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98] for i, (_, x, *_) in enumerate(rows)}
    ids = [r[0] for r in rows]
    assert found == sorted((ids[i], len(js), min([ids[i], *(ids[j] for j in js)]), ids[i] == min([ids[i], *(ids[j] for j in js)])) for i, js in near.items())


def test_embedding_blocks(spark, monkeypatch):
    """A bucket larger than a block is dealt out and still counts every link once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    v = (np.ones(16) + 0.02 * rng.standard_normal((100, 16))).astype(np.float32)
    found = embedding_dedup.near_embeddings(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(99, 0)}


def test_near_duplicates(spark, docs, rows):
    expected = brute.near(rows)
    for r in minhash_dedup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)
    again = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    found = minhash_dedup.near_duplicates(again).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_edited_copies(spark):
    """A large group of edited copies: links near the threshold, many of them away from any centre."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(250):
        own = list(words)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(5000)}"
        if i % 7 == 0:
            words = own
        rows.append((i, " ".join(own)))
    expected = brute.near(rows)
    for r in minhash_dedup.near_duplicates(documents(spark, rows)).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.default_vocabulary())
    texts, sequences, by_doc = dict(rows), {}, {}
    found = packing.packed(docs, with_ids=True).collect()
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = [*encoder.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert all(r.start == sum(x.length for x in own[: r.piece]) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in own)
        assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.packed(empty(spark)).count() == 0


def test_packing_plan():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 64, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 200) for _ in range(rng.randint(1, 40))}
        plan = packing.planned(counts, capacity)
        runs = sorted(plan.rows)
        fill, large, seen = {}, {}, 0
        for k, (length, lo, first, per_bin, offset) in enumerate(runs):
            hi = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else counts[length]
            for i in range(hi - lo):
                place = (first + i // per_bin, offset + i % per_bin * length)
                fill.setdefault(place[0], []).append((place[1], length))
                large[place[0]] = large.get(place[0], 0) + (3 * length > capacity)
                seen += 1
        assert seen == sum(counts.values()) and max(large.values(), default=0) <= 2
        for own in fill.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(fill) <= 1.25 * sum(k * n for k, n in counts.items()) / capacity + sum(n for k, n in counts.items() if 2 * k > capacity) + 1


def test_contamination(spark, docs, rows):
    texts = dict(rows)
    items = [(0, texts[9]), (1, None), (2, "..."), (3, "Word"), (4, " ".join(texts[8].split()[5:12])), (11, texts[9]), (5, texts[5][:90])]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    more = rows + [(500, "A word, word-for-word: WORD")]
    found = sorted(map(tuple, decontaminate.contamination(documents(spark, more), table).collect()))
    assert found == sorted(brute.contamination(more, items))
    assert decontaminate.contamination(empty(spark), table).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, table.limit(0)).collect())
    twice = decontaminate.contamination(documents(spark, [(1, "x word"), (1, "x word"), (1, "y"), (None, "word")]), table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in twice) == [("1", 1, 0), ("1", 2, 1), ("1", 2, 1), ("None", 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(documents(spark, more), table).collect()) == [d for d, _, n, *_ in sorted(brute.contamination(more, items)) if not n]


def test_many_windows(spark):
    """More windows than bits of the sieve, no broadcast, one passage in a third of all rows, an item in every window's list."""
    names = {"SIEVE_LEAST": 64, "SIEVE_PER_KEY": 1, "SIEVE_MOST": 256}
    before, limit = {k: getattr(shared, k) for k in names}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    items = [(i, text(rng.randint(1, 60))) for i in range(60)] + [(100 + i, "one very common passage of exactly ten words for all") for i in range(5)]
    rows = [(i, text(40) + " " + rng.choice(items)[1] + " " + text(rng.randint(0, 30)) + (f" {items[-1][1]}" if i % 3 == 0 else "")) for i in range(150)]
    rows += [(7, "x " * 60_000 + items[3][1]), (8, items[-1][1])]
    table = spark.createDataFrame(items, "item_id int, text string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for k, v in names.items():
            setattr(shared, k, v)
        found = sorted(map(tuple, decontaminate.contamination(documents(spark, rows), table).collect()))
        left = sorted(map(str, (tuple(r) for r in decontaminate.decontaminated(documents(spark, rows), table).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for k, v in before.items():
            setattr(shared, k, v)
    expected = brute.contamination(rows, items)
    assert found == sorted(expected)
    clean = {(r[0], r[1]) for r, e in zip(rows, expected) if not e[5]}
    assert left == sorted(str(tuple(r)) for r in documents(spark, rows).collect() if (r.doc_id, r.text) in clean)


def test_sieve(spark):
    keys = shared.stored(spark.range(1000).selectExpr("xxhash64(id) AS k"), "keys")
    test = shared.sieve(keys, "k")
    assert keys.where(test(F.col("k"))).count() == 1000
    assert spark.range(5000, 15_000).where(test(F.xxhash64("id"))).count() < 1500
    assert spark.range(100).where(shared.sieve(keys.limit(0), "k")(F.xxhash64("id"))).count() == 0


def test_urls(spark, duck):
    link = '<LINK href="{}" rel=canonical>'
    rows = [
        (1, "https://a.example.com/en/1", None), (2, "http://x.org/1", link.format("https://a.example.com/en/1")), (3, "http://y.org/2?q=1#f", '<meta http-equiv="refresh" content="0; url=//x.org/1">'),
        (4, "http://example.com/en/7x", ""), (5, "http://z.org/3", link.format("http://example.com/en/7x")), (6, None, None), (7, "no scheme", link.format("http://a.com/en/")), (8, "http://Sub.NET/de/9", None),
        (9, "ftp://example.net/de/8?x", None), (10, "http://w.org/4", link.format("/es/5")), (11, "http://w.org/4", link.format("/es/5")), (12, "http://comx/en/", None),
        (13, "http://r.org/d/a", link.format("b?x") + link.format("?q")), (14, "http://r.org/d/b?x", link.format("https://s.com/en/9")), (15, "http://r.org/d/a?q", None), (16, "http://t.org", link.format("mailto:x") + link.format("u")), (17, "http://t.org/u", link.format("https://s.com/en/9")),
        (18, "http://v.org/long", "<p>" + "x" * 300_000 + link.format("https://s.com/en/9")), (None, "http://com/en/", None), (None, "http://w.net/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert found[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert found[2][2:] == (None, "block") and found[3] == ("y.org", "/2", None, "block")
    assert found[4][2:] == ("example.com/en/7", "allow") and found[5][2:] == (None, "allow")
    assert found[6] == ("", "", None, "allow") and found[7] == ("", "", None, "allow")
    assert found[8] == ("sub.net", "/de/9", "net/de/", "allow") and found[9][2:] == ("example.net/de/8", "block")
    assert found[10][2:] == found[11][2:] == (None, "block") and found[12][2:] == (None, "allow")
    assert sorted(str(r.page_id) for r in url_filter.kept_pages(pages).collect()) == sorted(["4", "5", "6", "7", "8", "12", "None"])
    assert all(found[i][2:] == (None, "block") for i in (13, 14, 15, 16, 17, 18))
    clash = pages.withColumnsRenamed({"page_id": "node", "url": "host", "html": "rule"}).withColumn("component", F.lit(1))
    again = url_filter.judged(clash, id_col="node", url_col="host", html_col="rule").collect()
    assert sorted(str(tuple(r)) for r in again) == sorted(str(tuple(r)) for r in url_filter.judged(pages).collect())
    assert url_filter.judged(pages.limit(0)).count() == 0
    import duckdb

    frame = pages.toPandas()  # noqa: F841  DuckDB reads it by name
    con = duckdb.connect()
    con.register("pages", frame)
    assert {r[0]: tuple(r[1:]) for r in con.sql(url_filter.ORACLE).fetchall() if r[0] is not None and r[0] == r[0]} == {k: v for k, v in found.items() if k is not None}


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in queries.op9_quality_crf(spark, SF).collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert len(found) == docs.count()
    held = [i for i in marks if found[i].held_out]
    assert held and all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert sum(found[i].predicted == marks[i] for i in held) / len(held) >= 0.9
    model = quality.fitted(docs, labels)
    odd = {r.doc_id: r.score for r in quality.quality_scores(documents(spark, [(1, None), (2, ""), (3, "  \n "), (4, "a"), (4, "a")]), model).collect()}
    assert odd[1] == odd[2] == odd[3] and all(0 <= s <= 1 for s in odd.values())
    assert quality.quality_scores(empty(spark), model).count() == 0
    assert quality.fitted(docs, labels.limit(0)).quality([quality.document_features("x")])[0] == 0.5


def test_quality_chain():
    """Forward-backward equals the sum over all labellings."""
    rng = np.random.default_rng(0)
    scores, turn = [rng.standard_normal(n) for n in (1, 3, 4)], rng.standard_normal((2, 2))
    total, good, moves = quality.marginals(scores, turn)
    expected = np.zeros((2, 2))
    for row, s in enumerate(scores):
        weights, marks = [], []
        for code in range(2 ** len(s)):
            y = [code >> t & 1 for t in range(len(s))]
            weights.append(np.exp(sum(s[t] * y[t] for t in range(len(s))) + sum(turn[a, b] for a, b in zip(y, y[1:]))))
            marks.append(y)
        z = sum(weights)
        assert np.isclose(total[row], np.log(z))
        for t in range(len(s)):
            assert np.isclose(good[row, t], sum(w for w, y in zip(weights, marks) if y[t]) / z)
        for w, y in zip(weights, marks):
            for a, b in zip(y, y[1:]):
                expected[a, b] += w / z / len(s)
    assert np.allclose(moves, expected)


def test_repeats(spark, docs, rows):
    found = sorted(map(tuple, substring_dedup.removed_repeats(docs).collect()))
    assert found == sorted(brute.repeats(rows))
    texts, kept = dict(rows), {r.doc_id: r for r in substring_dedup.removed_repeats(docs, with_text=True).collect()}
    assert all(brute.sha(r.kept_text) == r.kept_sha256 for r in kept.values() if r.n_removed)
    assert kept[6].kept_text == "" and kept[5].kept_text is None
    same = documents(spark, [(1, texts[5]), (1, texts[5]), (2, texts[5]), (None, texts[5])])
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.removed_repeats(same).collect()) == [("1", 0), ("1", 0), ("2", 400), ("None", 0)]
    assert substring_dedup.removed_repeats(empty(spark)).count() == 0


def test_repeats_in_other_contexts(spark):
    """Two later documents share a passage that the first one with their seed does not have."""
    rng = random.Random(6)
    words = [f"v{rng.randrange(60)}" for _ in range(4000)]
    rows = []
    for i in range(60):
        a = rng.randrange(3800)
        rows.append((i, " ".join([f"u{i}", *words[a : a + rng.randint(40, 180)], f"t{i}", *words[a // 2 : a // 2 + 55]])))
    assert sorted(map(tuple, substring_dedup.removed_repeats(documents(spark, rows)).collect())) == sorted(brute.repeats(rows))


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_types(spark):
    """Digest columns have the types of their contracts."""
    expected = {
        "op1_kd_sharding": {"size": T.LongType(), "text_crc32": T.LongType(), "shard": T.IntegerType(), "slot": T.LongType(), "grown_shard": T.IntegerType()},
        "op4_embedding_itq": {"n_links": T.LongType(), "component_id": T.LongType(), "kept": T.BooleanType()},
        "op5_minhash_near_dedup": {"n_shingles": T.LongType(), "component_id": T.LongType(), "kept": T.BooleanType()},
        "op6_best_fit_packing": {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "sequence_id": T.LongType(), "offset": T.LongType()},
        "op10_substring_dedup": {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()},
    }
    for name, columns in expected.items():
        schema = queries.queries()[name](spark, SF).schema
        assert {c: schema[c].dataType for c in columns} == columns, name


def test_url_oracle(spark, duck):
    columns = ["page_id", "host", "path", "rule", "verdict"]
    found = duck.sql(queries.oracle_sql()["op8_url_filter"])
    at = [found.columns.index(c) for c in columns]
    rows = sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
    assert rows == sorted(str(tuple(r[c] for c in columns)) for r in queries.op8_url_filter(spark, SF).collect())


def test_sizes_follow_the_whole_table(spark):
    """Nothing outside the named columns changes a result."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plain = sorted(map(tuple, substring_dedup.removed_repeats(d).collect()))
    assert plain == sorted(map(tuple, substring_dedup.removed_repeats(d.withColumn("class", F.lit(1)).withColumn("seed", F.lit("x"))).collect()))
