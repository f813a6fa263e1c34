"""The corpus operators against brute force on small tables with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from tokenizers import Tokenizer, models

from varloom.llm import bpe, chat, decontam, embeddings, graph, quality, simhash, substring, suffix, tokens, toxicity

DOC = "doc_id long, text string, n_chars string, doc string, key string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(5, 160)) for _ in range(30)]
    passage = words(rng, 60)
    texts = [*base, *base[:8], *[t.replace("w1", "W1", 1) for t in base[:8]]]
    texts += [f"{words(rng, 9)} {passage}\n{words(rng, 7)}" for _ in range(6)]
    texts += [f"{passage} {passage}", "", " \t\n", None, "one", "two words", "é" * 70 + " 你好" * 30, "a" * 3000, words(rng, 9000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(10 * k, texts[i]) for k, i in enumerate(order)]
    return [*out, (None, base[0]), (None, None), out[3], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", None) for i, t in rows], DOC).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


class Sets:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# graph


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 90), (90, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    sets = Sets({x for e in edges if None not in e and e[0] != e[1] for x in e})
    for a, b in edges:
        if a is not None and a != b:
            sets.union(a, b)
    assert got == {k: sets.find(k) for k in sets.up}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_fingerprint_of_any_block_size(monkeypatch):
    text = words(random.Random(1), 500).encode()
    want = plain_fingerprint(text.decode())
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == want


def test_near_duplicates(docs, rows, nothing):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    fps = [(i, simhash.signed(plain_fingerprint(t))) for i, t in rows]
    sets = Sets({i for i, _ in fps if i is not None})
    known = [(i, f) for i, f in fps if i is not None]
    for a, fa in known:
        for b, fb in known:
            if ((fa ^ fb) & (1 << 64) - 1).bit_count() <= 4:
                sets.union(a, b)
    by_fp = {f: sets.find(i) for i, f in known}
    assert sorted(got, key=str) == sorted(((i, f, by_fp.get(f)) for i, f in fps), key=str)
    assert simhash.near_duplicates(nothing).collect() == []


def test_long_lists_are_refined_without_loss(spark, monkeypatch):
    """A dense ball of fingerprints around one centre, with lists of two rows at most."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 70:
        f = centre
        for _ in range(rng.randrange(1, 8)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(simhash.signed(f) for f in fps)
    monkeypatch.setattr(simhash, "LIST_ROWS", 2)
    monkeypatch.setattr(simhash, "_ROWS", 40)
    links = simhash.links(spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, doc long"))
    got = Sets(range(len(fps)))
    for a, b in links.distinct().collect():
        assert ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 64
        got.union(a, b)
    want = Sets(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 4:
                want.union(a, b)
    assert [got.find(k) for k in range(len(fps))] == [want.find(k) for k in range(len(fps))]


# embeddings


@pytest.mark.parametrize("block", [2048, 3])
def test_embedding_links(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings.links, "__defaults__", (block,))
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    near = base[:15] + 0.05 * rng.standard_normal((15, 16))
    vecs = [*base.tolist(), *near.tolist(), *base[:5].tolist(), *(3 * base[:2]).tolist()]
    label = [k % 3 for k in range(len(vecs))]
    label[40:55] = label[:15]
    label[55:60] = label[:5]
    label[60:] = label[:2]
    rows = [(5 * k, v, lab, 0) for k, (v, lab) in enumerate(zip(vecs, label))]
    odd = [[0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, None, []]
    rows += [(1000 + k, v, 0, 1) for k, v in enumerate(odd)] + [(2000, vecs[0], None, 2), (2001, vecs[0][:8], 0, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int").repartition(3)
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(df).collect()}
    ok = [(i, np.array(v), lab) for i, v, lab, _ in rows if i < 1000 or i == 2001]
    sets, n = Sets({r[0] for r in rows}), dict.fromkeys((r[0] for r in rows), 0)
    for i, v, lab in ok:
        for j, w, lb in ok:
            if i != j and lab == lb and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93 - 1e-12:
                n[i] += 1
                sets.union(i, j)
    assert got == {i: (n[i], sets.find(i)) for i in n}
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_calibration():
    half, count = embeddings.calibrate(0.93, 32, 2.0, 1e-4)
    rng = np.random.default_rng(0)
    gaps = rng.standard_normal((20000, 32)) * np.sqrt(2 - 2 * 0.93)
    assert ((np.abs(gaps) <= half).sum(1) < count).mean() < 1e-3


# word windows


def plain_word_cuts(rows, window=20):
    seen, out = {}, {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            if seen.setdefault(b" ".join(w[s : s + window]), (i, s)) != (i, s):
                gone.update(range(s, s + window))
        out[i] = (w, gone)
    return out


def test_substring(docs, rows, nothing):
    want = plain_word_cuts(rows)
    got = substring.deduplicate(docs, keep=("key", "n_chars"), digest=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc"] is None:
            assert r["n_removed"] == 0
            continue
        w, gone = want[r["doc"]]
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["value"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert r["n_chars"] == "x"
    texts = dict((r["doc"], r["value"]) for r in substring.deduplicate(docs).collect())
    for i, t in rows:
        if i is not None:
            w, gone = want[i]
            assert texts[i] == (t if not gone else b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert substring.deduplicate(nothing).collect() == []


def test_cover_holds_an_aligned_anchor_for_every_shift():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % 13 in substring.COVER and (j + d) % 13 in substring.COVER for d in range(13))


def test_word_hashes_in_pieces(monkeypatch):
    data = np.frombuffer(b"  aa bb\tcc " + b"z" * 90 + b" aa\n" + b"bb " * 40, np.uint8)
    start, h = substring.words.hashes(data)
    monkeypatch.setattr(substring.words, "PIECE", 16)
    start2, h2 = substring.words.hashes(data)
    text = data.tobytes().split()
    assert start.tolist() == start2.tolist() and len(h2) == len(text)
    for hs in (h, h2):
        ids = {}
        for w, x in zip(text, hs.tolist()):
            assert ids.setdefault(w, x) == x
        assert len(set(ids.values())) == len(ids)


# byte strings


def test_suffix_order():
    rng = random.Random(4)
    for _ in range(600):
        x = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix.suffix_order(x) == sorted(range(len(x)), key=lambda i: x[i:])


def plain_byte_cuts(rows, window=50):
    seen, out = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        x = (t or "").encode()
        own = [x[s : s + window] for s in range(len(x) - window + 1)]
        gone = np.zeros(len(x), bool)
        for s, k in enumerate(own):
            if k in seen:
                gone[s : s + window] = True
        seen.update(own)
        out[i] = (x, gone)
    return out


@pytest.mark.parametrize("bucket", [20000, 1])
def test_byte_strings(docs, rows, nothing, bucket, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    if bucket == 1:  # texts over many pieces, blocks over two
        monkeypatch.setattr(suffix, "_PIECE", 301)
        monkeypatch.setattr(suffix, "BLOCK_SLICES", 5)
    want = plain_byte_cuts(rows)
    got = suffix.deduplicate(docs, digest=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc"] is None:
            assert r["n_removed"] == 0
            continue
        x, gone = want[r["doc"]]
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["value"]) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    if bucket > 1:
        assert suffix.deduplicate(nothing).collect() == []


# decontamination


def test_decontamination(spark, nothing):
    rng = random.Random(8)
    items = [(k, words(rng, 45, 3000)) for k in range(12)] + [(50, None), (51, ""), (52, "short"), (None, words(rng, 30)), (3, "again " + words(rng, 40, 3000))]
    docs, want = [], set()
    for k in range(60):
        text = words(rng, 120, 3000)
        if k % 3 == 0:
            item, body = items[k % 12]
            if k % 2:  # two edits, another case, other white space
                body = body.upper().replace(" ", "\n ", 5)
                body = body[:30] + "?" + body[31:90] + body[91:]
            text = f"{text} {body} {words(rng, 40, 3000)}"
            want.add((k, item))
        docs.append((k, text, "x", None, None))
    docs += [(100, None, "", "", ""), (101, "", "", "", ""), (None, items[0][1], "", "", ""), docs[0]]
    df = spark.createDataFrame(docs, DOC).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in decontam.contaminated(df, bench).collect()}
    assert got == want
    assert {(r["doc"], r["item"]) for r in decontam.passages(df, bench, pass_chars=700).collect()} == want
    assert decontam.contaminated(nothing, bench).count() == decontam.contaminated(df, bench.limit(0)).count() == 0


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_every_region_within_the_budget_is_found(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(decontam, "_BLOCK", 300)
    for _ in range(40):
        pattern = "".join(rng.choice("abcd ") for _ in range(100))
        body = list(pattern)
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(body))
            body[k : k + 1] = rng.choice(["", rng.choice("abcd"), body[k] + "x"])
        text = "".join(rng.choice("abcd ") for _ in range(200)) + "".join(body) + "".join(rng.choice("abcd ") for _ in range(150))
        index = decontam.Index(np.array([1]), [decontam._codes(pattern)])
        found = list(index.regions(decontam._codes(text)))
        assert bool(found) == (edit_distance_inside(pattern, text) <= decontam.edits(100))


# toxicity


def edits_to(word, body, stem):
    row = list(range(len(body) + 1))
    best = row[-1]
    for i, c in enumerate(word, 1):
        new = [i]
        for j, t in enumerate(body, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best if stem else row[-1]


def test_automata_agree_with_edit_distance():
    rng = random.Random(5)
    terms = ["abcd", "abcab", "dcbadcba", "abcdabcdab", "cabca*", "ddddddddd*"]
    root, matcher = toxicity.lexicon_trie(terms), toxicity.Matcher(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 13)))
        within = [(edits_to(word, t.rstrip("*"), t.endswith("*")), len(t.rstrip("*")), t.rstrip("*")) for t in terms]
        within = [x for x in within if x[0] <= toxicity.allowance(x[2])]
        want = (min(within)[2], min(within)[0]) if within else None
        assert toxicity.match(word, root) == want
        hits, n = matcher.hits(word)
        assert n == 1 and ([h[:2] for h in hits] == ([want] if want else []))


def test_quotation_window():
    m = toxicity.Matcher(["idiot"])
    plain, quoted, said = (m.hits(t)[0][0] for t in ("you IDIOT there", 'he read "a big idiot there" aloud', "the word idiot is old"))
    assert (plain[2], quoted[2], said[2]) == (False, True, True)
    assert m.hits("an id1ot, a idioot!")[0][0][1] == 1


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(900):
        text, bad, junk = words(rng, 60, 900), k % 7 == 0, k % 5 == 1
        if bad:
            term = rng.choice(["blorgus", "snarkel", "frimpest"])
            text = f"{text} {term} {words(rng, 5)} {term}"
        if junk:
            text = " ".join(f"{w}###" for w in text.upper().split())
        rows.append((k, text, "a", "b", "c"))
        labels.append((k, int(not junk), int(bad), None))
    rows += [(5000, None, "", "", ""), (5001, "", "", "", ""), (None, "blorgus", "", "", ""), (5002, "a b1orgus came", "", "", ""), rows[0]]
    labels += [(None, 1, 1, None), (3, None, None, None), (4, 7, 7, None), (9999, 1, 1, None), labels[0]]
    return spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {
        r[0]: (r[1], r[2]) for r in labels[:900]
    }


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(labelled, nothing, which):
    docs, labels, truth = labelled
    op, folds, held = (toxicity.classify, 4, 2) if which == "toxic" else (quality.classify, 5, 0)
    got = op(docs, labels).collect()
    assert len(got) == 905 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    right = seen = 0
    for r in got:
        if r["doc"] is None:
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc"]).encode()) % folds == held)
        if r["held_out"] and r["doc"] in truth:
            seen += 1
            right += r["predicted"] == truth[r["doc"]][which == "toxic"]
    assert seen > 100 and right / seen > 0.97
    if which == "toxic":
        assert next(r for r in got if r["doc"] == 5002)["predicted"] == 1
    assert op(nothing, labels).collect() == []
    blank = op(docs, labels.limit(0)).collect()
    assert len(blank) == 905 and len({r["score"] for r in blank}) == 1


def test_labels_of_the_held_out_fold_are_not_read(labelled):
    docs, labels, _ = labelled
    for op, folds, held in ((toxicity.classify, 4, 2), (quality.classify, 5, 0)):
        other = labels.filter(f"doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % {folds} <> {held}")
        a, b = (sorted((str(r["doc"]), round(r["score"], 9)) for r in op(docs, x).collect()) for x in (labels, other))
        assert a == b


# chat


def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = [*chat.CONTROLS, "\\", "<", "[", "/s>", "<<", "é", "\n", " ", "hi", "]", "你"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[TEXT]\\"]), text, None))
    rows += [(70, 0, None, None, None), (71, None, "user", "first", None), (71, 1, "user", "x", None), (71, 1, "user", "x", None), (None, 0, "user", "lost", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(4)
    got = {r["conv"]: r for r in chat.format_conversations(df).collect()}
    want = {}
    for c, t, role, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert chat.parse(r["formatted"]) == turns and r["n_turns"] == len(turns)
        said = "".join(chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"])
        assert said == "".join(t for role, t in turns if role == "assistant")
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_conversations_longer_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(chat, "ASSEMBLE", 200)
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} [INST]") for c in range(3) for t in range(5000 if c == 1 else 3)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert {r["conv"]: len(chat.parse(r["formatted"])) for r in got.collect()} == {0: 3, 1: 5000, 2: 3}


# byte-level BPE


@pytest.mark.parametrize("hot", [1 << 20, 5, 0])
def test_bpe_equals_the_library(spark, docs, rows, nothing, hot, monkeypatch):
    monkeypatch.setattr(bpe, "FOLD_BYTES", 200)
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["I'll don't  x y  z", "naïve Ünïcode 12345 ٣٤ ½ …!?", "tab\tnew\r\n\n  end  ", "😀 é ‍ ﻿\u0000", "<|endoftext|>"]
    more = spark.createDataFrame([(9000 + k, t, "", "", "") for k, t in enumerate(odd)], DOC)
    df = docs.filter("doc_id is null or length(coalesce(text, '')) < 5000").unionByName(more)
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, hot=hot)
    assert coded.columns == [*df.columns, "ids"]
    out = coded.select("doc_id", "text", "ids", bpe.decode(coded["ids"], RANKS).alias("bytes")).collect()
    assert len(out) == df.count()
    for r in out:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]) == (r["text"] or "").encode()
    if not hot:
        assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).collect() == []


def test_heap_merges_equal_the_library():
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for n in (1, 2, 30, 400):
        for alphabet in ("ab", "the re", "qé你"):
            w = "".join(rng.choice(alphabet) for _ in range(n))
            assert bpe.merge_long(w.encode(), ranks) == library.encode_ordinary(w)


# token counts


def test_token_counts_equal_a_unigram_library(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(tokens, "TRIE_NODES", 300)
    monkeypatch.setattr(tokens, "TRIE_BYTES", 100)
    scores = tokens.zipf_scores(RANKS)
    letter = {b: chr(0x100 + b) for b in range(256)}
    model = Tokenizer(models.Unigram([("".join(letter[c] for c in t), s) for t, s in scores.items()]))
    find = regex.compile(public_tokenizers.PATTERN).findall
    got = tokens.count_tokens(docs, scores, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r["doc"] is not None:
            parts = find(texts[r["doc"]] or "")
            count = sum(len(model.encode("".join(letter[c] for c in p.encode())).ids) for p in parts)
            assert (r["n_words"], r["n_tokens"]) == (len(parts), count)
    assert tokens.count_tokens(nothing, scores, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, {b"a": 0.0}, "a")


def test_forward_scores_are_the_best():
    rng = random.Random(11)
    scores = {bytes([c]): -5.0 for c in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))): -rng.randrange(1, 9) for _ in range(60)}
    model = tokens.Forward(scores)

    def best(w):
        top = {0: (0.0, 0)}
        for k in range(1, len(w) + 1):
            top[k] = max((top[j][0] + scores[w[j:k]], top[j][1] - 1) for j in range(k) if w[j:k] in scores)
        return -top[len(w)][1]

    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        assert model.tokens(w) == best(w.encode()) == model._alone(w.encode())
