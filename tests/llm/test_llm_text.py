"""Word-level operators against brute force and the tokenizer libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regscope.llm import mixing, ngram_join, pii, sentence_pieces, token_files, weighted_sampling
from regscope.llm.queries import TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rid string, ids string, k int, _key int"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(d, t, "en", s, None if t is None else len(t), 7, "x", "y", 1, 2) for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (3, "one two", "b"), (4, "ONE\x0btwo", "b"), (5, "one", None)]
    for f in range(6):  # families of near copies around one text, some below the threshold
        base = words(rng, 60 + 30 * f, 500).split()
        for i in range(12):
            new = list(base)
            for _ in range(rng.randrange(7)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10 ** 6)}"
            out.append((len(out), " ".join(new), rng.choice("abc")))
    line = words(rng, 30, 10 ** 6)
    for i in range(40):  # a passage that many texts share, in long and short texts
        out.append((len(out), f"{words(rng, rng.choice([3, 20, 200]), 10 ** 6)} {line}", "hot"))
    out += [(len(out) + i, out[10][1], "hot") for i in range(20)]
    out += [(7, out[7][1], "a"), (7, out[30][1], "a"), (None, out[40][1], "a"), (None, "nobody", "a")]
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    degree = Counter()
    texts = sorted({s for s in sets if s}, key=lambda s: sets.index(s))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    for a in texts:
        degree[a] = sum(100 * len(a & b) >= 75 * len(a | b) for b in texts if b != a)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d, degree[s], root(i)) for i, ((d, *_), s) in enumerate(zip(rows, sets))]


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.mark.parametrize("short,block", [(128, 512), (16, 5)])
def test_join_matches_brute_force(spark, rows, monkeypatch, short, block):
    """Also with limits so small that prefixes, cuts and pairs of blocks matter."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    got = ngram_join.ngram_join(docs(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=key) == sorted((r[:4] for r in brute_components(rows)), key=key)


def test_join_passage_ties_no_family(spark, monkeypatch):
    """Texts that share a passage, but have n-grams of their own enough, are not multiplied block by block."""
    rng = random.Random(8)
    line = words(rng, 120, 10 ** 6)
    rows = [(i, f"{line} {words(rng, 180, 10 ** 9)}", "a") for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} and more", "b") for i in range(3)]  # near copies among them
    met, real = [], ngram_join._products
    monkeypatch.setattr(ngram_join, "_products", lambda *a: met.append(a[-3].groupBy("component").count().collect()) or real(*a))
    got = ngram_join.ngram_join(docs(spark, rows)).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(r[:4] for r in brute_components(rows))
    assert [r["count"] for r in met[0]] == [2, 2, 2]


def test_join_of_nothing(spark, rows):
    assert ngram_join.ngram_join(docs(spark, rows[:1]).limit(0)).count() == 0
    assert ngram_join.keep_one(docs(spark, rows[:1]).limit(0)).count() == 0


def test_keep_one_of_each_group(spark, rows):
    table = docs(spark, rows)
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=key)
    component = {}
    for (d, t, _), (_, n, least, _, root) in zip(rows, brute_components(rows)):
        component.setdefault(("empty", len(component)) if n == 0 else root, []).append((d, t, least))
    # One row of each component, with its smallest id; every row without words.
    assert len(got) == len(component)
    for members in component.values():
        assert sum((d, t) in got for d, t in {(d, t) for d, t, least in members if d == least}) >= 1


def test_links_between_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    i, j = ngram_join.links_between(sets, sets, True, 60)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)
            if 100 * len(set(sets[a]) & set(sets[b])) >= 60 * len(set(sets[a]) | set(sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_mix(spark, rows):
    table = docs(spark, rows)
    plan = mixing.mix_plan(table).collect()
    sizes = Counter()
    for d, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:  # cap and share anew until none is above
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    got = {r.source: r.target for r in mixing.source_targets(
        table.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in names)
    assert len(plan) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in plan)
    assert sorted(plan, key=str) == sorted(mixing.mix_plan(table).collect(), key=str)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(table.limit(0)).count() == 0 and mixing.mix(table.limit(0)).count() == 0


NASTY = ["", " ", "  a  b ", "▁▁x", "<s></s><0x41>", "ﬁ Ａ́ ​😀\x00\n\t", "a" * 3000, "it's we'll 7½ x<|endoftext|>y", "ΣΑΣ İß ÉÈ",
         " " * 500 + "z", " 　 é", "the, the. The"]


def test_pieces_match_the_library(spark, rows):
    spm = pytest.importorskip("sentencepiece")
    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    sp = spm.SentencePieceProcessor(model_file=path)
    model = sentence_pieces.read_model(path)
    own = sentence_pieces.PieceModel(model)
    rng = random.Random(9)
    texts = NASTY + ["".join(rng.choice("ab Th▁\n\té中ﬁ0.<s>😀  ") for _ in range(rng.randrange(90))) for _ in range(400)]
    for t in texts:
        ids, begins, ends = own.encode(t)
        assert ids.tolist() == sp.encode(t) and own.decode(ids) == sp.decode(sp.encode(t))
        assert len(ids) == 0 or (begins[0] == 0 and ends[-1] == len(t.encode()) and (begins[1:] == ends[:-1]).all())
    for _ in range(300):  # ids that no text gives
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, np.int64)) == sp.decode(ids)
    table = docs(spark, rows + [(100 + i, t, "n") for i, t in enumerate(NASTY)])
    got = sentence_pieces.round_trips(table, model).collect()
    by_text = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}
    for d, t in [(d, t) for d, t, _ in rows] + [(100 + i, t) for i, t in enumerate(NASTY)]:
        ids = sp.encode(t or "") + [2]
        assert (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(sp.decode(ids).encode()).hexdigest()) in by_text
    encoded = sentence_pieces.encode(table, model)
    back = sentence_pieces.decode(encoded, model).select("text", "decoded").collect()
    assert all(sp.decode(sp.encode(r.text or "")) == r.decoded for r in back) and set(table.columns) - {"ids"} < set(encoded.columns)
    assert sentence_pieces.round_trips(table.limit(0), model).count() == 0


def test_decoding_looks_only_at_odd_pieces():
    m = sentence_pieces.PieceModel(sentence_pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model"))
    ids = m.encode("the words of a plain text " * 50 + "☃\x01")[0]

    class Counted(list):
        looks = 0

        def __getitem__(self, i):
            Counted.looks += 1
            return super().__getitem__(i)

    m.types = Counted(m.types)
    assert m.decode(ids) == "the words of a plain text " * 50 + "☃\x01"
    assert Counted.looks == int(m.odd[ids].sum()) < 10


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_character_map(rule):
    spm = pytest.importorskip("sentencepiece")
    from regscope.llm.sentence_pieces import CharMap, PieceModel, _fields
    for squeeze in (False, True):
        lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)
        m = PieceModel(sentence_pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model"))
        m.map, m.dummy, m.squeeze = CharMap(dict(_fields(dict(_fields(lib.serialized_model_proto()))[3]))[2]), False, squeeze
        for t in NASTY + ["①½ﬃ  ｱﾞ x"]:
            normal, where = m.normalise(t)
            assert normal.decode().replace("▁", " ") == lib.normalize(t).replace("▁", " ")
            assert len(where) == len(normal) + 1 and (np.diff(where) >= 0).all() and where[-1] <= len(t.encode())


def test_packed_files_match_the_library(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    with open(f"{TOKENIZERS}/word_bpe_49k.json", encoding="utf-8") as f:
        spec = f.read()
    enc = token_files.encoder(spec)
    rng = random.Random(2)
    for t in NASTY + ["".join(rng.choice("ab ThÉéİßΣσ.,'s \n\t7 ﬁ😀-_ll") for _ in range(rng.randrange(60))) for _ in range(500)]:
        assert enc.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    cases = [r for r in rows if r[0] != 7 or r[2] != "a"][:60] + [(1000 - i, t, "n") for i, t in enumerate(NASTY)]
    path = token_files.write_shards(docs(spark, cases), spec, end_id=2)
    got = sorted(map(tuple, token_files.digests(spark, path).collect()), key=lambda x: x[1])
    at, want = 0, []
    for d, t, _ in sorted(cases, key=lambda r: (r[0] is not None, r[0])):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    whole = {(r.doc_id, tuple(r.ids)) for r in token_files.read_shards(spark, path).collect()}
    assert len(whole) == len(cases)
    empty = token_files.write_shards(docs(spark, cases).limit(0), spec, end_id=2)
    assert token_files.digests(spark, empty).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype("<u4")
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-999 * bits // 8)
    for a, b in ((0, 999), (5, 5), (7, 8), (333, 700)):
        assert (token_files.unpack(packed, bits, a, b) == ids[a:b]).all()
    assert token_files.min_bits(49408) == 16 and token_files.min_bits(2) == 1 and token_files.min_bits(65537) == 17


def test_broken_block_is_noticed():
    data = token_files.block(9, [3, None], [2, 1], np.array([5, 6, 7]))
    bad = bytearray(data)
    bad[-1] ^= 1
    foot = token_files.struct.pack("<4sI", b"FWBI", 1) + np.array([0], "<u8").tobytes() + np.array([0, 3], "<u8").tobytes()
    foot += token_files.struct.pack("<Q", len(foot) + 8) + b"\n"
    shard = token_files.Shard(data + b"\n" + foot)
    shard.check(0)
    assert shard.docs(0)[0] == [3, None] and shard.ids(1, 3).tolist() == [6, 7]
    with pytest.raises(ValueError):
        token_files.Shard(bytes(bad) + b"\n" + foot).check(0)


# -- personal data -------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_finders_match_the_patterns():
    rng = random.Random(3)
    for letters in ("ab@.-1 ", "0123 -.@a+()", "@a.@b.c@ -", "+1 ().-9x", "55.2.1 ", "4532 0-é"):
        for _ in range(3000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
            assert pii.base_spans(t) == plain_base(t), t
    assert pii.luhn("4532015112830366") and pii.base_spans("x 4532-0151-1283-0366.") == [(2, 2, 21)]
    for t in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+1 " + "(" * 300_000, "a@" * 100_000):
        pii.base_spans(t)  # linear


def test_pii_report_and_mask(spark, rows):
    rng = random.Random(4)
    more = []
    for i in range(60):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(32)) + "0a"
        more.append((500 + i, f"{words(rng, 5)} password={secret} {words(rng, 4)} a.b@mail.example.com +1 (555) 123-4567 version 2.0 and 12 more", "s"))
    table = docs(spark, rows + more)
    got = pii.report(table).collect()
    assert len(got) == len(rows) + len(more)
    for r in (r for r in got if r.doc_id is not None and r.doc_id >= 500):
        text = dict((d, t) for d, t, _ in more)[r.doc_id]
        own = plain_base(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1)
        assert r.base_sha256 == hashlib.sha256(pii.listed(own).encode()).hexdigest()
        assert set(pii.listed(own).split(",")) < set(r.spans.split(",")) and r.n_secret == 1
    masked = pii.mask(table)
    assert masked.columns == table.columns
    by_id = {r.doc_id: r for r in masked.collect()}
    assert "[SECRET]" in by_id[500].text and "[EMAIL]" in by_id[500].text and "version 2.0 and 12 more" in by_id[500].text
    assert by_id[500].n_chars == len(by_id[500].text) and by_id[0].text is None and by_id[3].text == "one two"
    assert pii.report(table.limit(0)).count() == 0 and pii.mask(table.limit(0)).count() == 0


def test_secrets_of_letters_are_candidates(spark):
    found = lambda t: [t[c.start:c.end] for c in pii.candidates(t, pii.base_spans(t))]
    assert found("my password=correcthorse here") == ["password=correcthorse"]
    assert found("token: abcdefghijkl") == found("Authorization: Bearer abcdefghijkl") == ["abcdefghijkl"]
    assert found("sk-abcdefghijkl and ghp_abcdefghij") == ["sk-abcdefghijkl", "ghp_abcdefghij"]
    assert found("a password manager, the secret of all things, password: a b") == found("") == found(None) == []
    for t in ("a" * 300_000 + "1", "password" * 40_000 + "1", "password=" * 40_000, "sk-" * 100_000, "bearer " + " " * 300_000):
        assert len(found(t)) <= 1  # linear
    rng = random.Random(6)
    letters = lambda k: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(k))
    table = docs(spark, [(i, f"{words(rng, 6)} password={letters(18)} {words(rng, 4)} page 12 of 300 by a manager", "s") for i in range(80)])
    texts = [r.text for r in pii.mask(table).collect()]
    assert all("[SECRET]" in t and "page 12 of 300 by a manager" in t for t in texts)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, truth, ~truth) * 2 - 1
    bad = rng.integers(0, 2, 4000) * 2 - 1
    votes = np.stack([good, good * (rng.random(4000) < 0.6), bad], axis=1).astype(int)
    prior, tables, post = pii.em(votes, np.ones(4000))
    assert abs(prior - 0.3) < 0.1 and ((post > 0.5) == truth).mean() > 0.9
    assert tables[1, 0, 2] > 0.8 and abs(tables[1, 2, 2] - tables[0, 2, 2]) < 0.15


# -- fingerprints ---------------------------------------------------------------
def test_fingerprints_estimate_generalised_jaccard(spark, rows):
    cases = [r for r in rows if r[0] is not None][:-2]
    got = {r.doc_id: r for r in weighted_sampling.edited_fingerprints(docs(spark, cases)).collect()}
    assert len(got) == len(cases)
    ordered = sorted(((d, t or "") for d, t, _ in cases), reverse=True)

    def similar(a, b):
        x, y = Counter(a.lower().split()), Counter(b.lower().split())
        return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0

    errors = []
    for i, (d, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - similar(t, edited), r.near_next - similar(t, after)]
        if t == edited and t.split():
            assert r.fingerprint == r.edited_fingerprint
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    same = {}
    for d, t in ordered:
        same.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_fingerprint_cases(spark, rows):
    f = weighted_sampling.edited_fingerprints
    assert f(docs(spark, rows).limit(0)).count() == 0
    alone = f(docs(spark, [(5, "ab cd", "a")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    odd = f(docs(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, None, "x"), (2, "", "x")])).collect()
    assert len(odd) == 4 and sorted(r.fingerprint for r in odd)[:2] == ["-", "-"]
