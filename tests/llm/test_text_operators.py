import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
import helpers  # noqa: E402

from lodestack.llm import decontaminate, licences, packing, pii, quality, repeats, simhash, tokenfile  # noqa: E402
from lodestack.llm.entries import TOKENIZER  # noqa: E402
from lodestack.llm.tokens import Encoder, encoder  # noqa: E402
from lodestack.scratch import new_path  # noqa: E402

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x_y+z@d-e.f.g", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0199", "+12", " ", "7", "-", "é", "0" * 20]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 9)))
        assert pii.detect(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "(at) " * 50_000, "one " * 100_000, " " * 300_000, "a " + " " * 200_000 + "at", "( " * 100_000, "1 " + " \t" * 100_000, "one.-" * 60_000, "(" + " " * 200_000, "x at " * 60_000, "\u200b" * 100_000):
        pii.disguised(text, pii.detect(text))


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("write john.doe (at) example (dot) com now", "email:6:37"), ("john at mail dot example dot org!", "email:0:32"),
        ("call plus one two one two five five five one two three four", "phone:5:59"), ("jоhn@exаmple.com", "email:0:16"),
        ("card four one one one 1111 one one one one 1111 end", "card:5:47"), ("tel +1​ 212 555 1234", "phone:4:20"),
        ("to john.doe [at]\texample [dot] com", "email:3:34"), ("to john.doe    (at)    example (dot)\n com.", "email:3:41"), ("to john.doe [a\u200bt] exam\u200bple.com", "email:3:30"),
        ("card 4 one one o\u200bne 1111 1111 one one one one", "card:5:45"), ("ip 10 \u200bdot 0 d\u200bot 0 dot 7", "ip:3:25"),
        ("we met at the dot on the map", ""), ("one two three", ""), ("look at that point here", ""),
    ],
)
def test_disguises_map_back_to_the_source(text, spans):
    base = pii.detect(text)
    assert pii.joined(base + pii.disguised(text, base)) == spans


def disguise_of(r, plain):
    """A disguise of an identifier, sign by sign, with nothing that the detectors of the source would find."""
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    wide = {c: chr(ord(c) + 0xFEE0) for c in "0123456789abcdefghijklmnopqrstuvwxyz"}
    digits = plain.replace(".", "").replace(" ", "").replace("+", "").isdigit()
    out, style = [], r.choice(["wide", "hidden", "named"])
    for i, c in enumerate(plain):
        if c == "@":
            out.append(r.choice([" [at] ", "(at)", "\t{ at }\t", " <@> ", "    (AT)    "]))
        elif c == "." and not digits:
            out.append(r.choice([" [dot] ", "(dot)", " dot ", ".", "\t[.] "]))
        elif c == ".":
            out.append(r.choice([" dot ", "[dot]", " ( punkt ) "]))
        elif style == "wide" and c in wide and (i < 2 or r.random() < 0.5):
            out.append(wide[c])
        elif style == "hidden" and (i == 1 or r.random() < 0.3) and i:
            out.append(r.choice(list(pii._INVISIBLE)) + c)
        elif style == "named" and digits and c.isdigit():
            out.append(("" if not out or out[-1][-1] in "+ )]" else " ") + names[int(c)])
        else:
            out.append(c)
    return "".join(out)


def test_offsets_against_disguises_made_sign_by_sign():
    r = random.Random(21)
    plains = {"email": ["jo.hn@mail.example.com", "a@b.org"], "ip": ["10.0.200.7", "1.2.3.4"], "card": ["4111111111111111", "4111 1111 1111 1111"], "phone": ["+12125550199", "+49 170 5550199"]}
    for _ in range(1500):
        kind = r.choice(list(plains))
        before, after = (helpers.prose(r.randrange(99), r.randint(0, 5)).replace("seven", "quiet") for _ in range(2))
        hidden = disguise_of(r, r.choice(plains[kind]))
        text = f"{before}: {hidden}; {after}"
        start = len(before) + 2
        base = pii.detect(text)
        spans = pii.joined(base + pii.disguised(text, base)).split(",")
        assert f"{kind}:{start}:{start + len(hidden)}" in spans, (text, spans)


def test_redaction():
    text = "a@b.co and 1.2.3.4"
    assert pii.redact(text, pii.detect(text)) == "[EMAIL] and [IP]"


def test_pii_rows(spark):
    rows = {(r.doc_id, r.n_email, r.base_sha256, r.spans) for r in pii.find(helpers.documents(spark, [(1, None), (2, "x a@b.co é 1.2.3.4"), (2, "x a@b.co é 1.2.3.4"), (None, "")])).collect()}
    none = hashlib.sha256(b"").hexdigest()
    want = "email:2:8,ip:11:18"
    assert rows == {(1, 0, none, ""), (2, 1, hashlib.sha256(want.encode()).hexdigest(), want), (None, 0, none, "")}
    assert pii.find(helpers.documents(spark)).count() == len(helpers.edge_rows()) and pii.find(helpers.empty(spark)).count() == 0
    kept = pii.redacted(helpers.documents(spark, [(1, None), (2, "a@b.co")]))
    assert kept.columns == helpers.documents(spark).columns and {(r.doc_id, r.text) for r in kept.collect()} == {(1, None), (2, "[EMAIL]")}


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    for t in ["", " ", "A", "a B", "İ I", "x\x0by\x85z w", *(helpers.prose(i, i) for i in range(0, 600, 37)), "b " * 700]:
        assert simhash.fingerprint(t) == fingerprint(t)


def brute_components(codes, limit):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= limit:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 4])
def test_links_lose_nothing(spark, limit):
    r = random.Random(limit)
    codes = []
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(12):
            codes.append(c)
            for _ in range(r.randint(1, 3)):
                c ^= 1 << r.randrange(64)
    codes = list(dict.fromkeys(codes))
    reps = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, rep long")
    from lodestack.operators.components import connected_components

    got = {x["node"]: x["component"] for x in connected_components(simhash.links(reps, 3, limit)).collect()}
    want = brute_components(codes, 3)
    assert [got.get(i, i) for i in range(len(codes))] == want


def test_index_prunes_and_finds_the_same_pairs():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0xFFF00000000000FF))
    index = simhash.GrayIndex(np.zeros(len(codes), dtype=np.int64), codes)
    a, b = index.search(0, len(codes), 3)
    got = {tuple(sorted((int(index.codes[x]), int(index.codes[y])))) for x, y in zip(a, b)}
    want = {(int(x), int(y)) for i, x in enumerate(codes) for y in codes[i + 1 :] if int(x ^ y).bit_count() <= 3}
    assert got == want and len(want) > 0
    assert index.levels[0][1][0] & index.levels[1][1][0] == 0  # shared bits are factored out of the leaves


def test_simhash_rows(spark):
    out = simhash.near_duplicates(helpers.documents(spark)).collect()
    got = {(r.doc_id, r.component_id) for r in out}
    assert len(out) == len(helpers.edge_rows()) and got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, None), (8, 8), (9, 9)}
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0


def edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_distance():
    r = random.Random(5)
    for _ in range(600):
        item, text = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(1, 12), r.randint(1, 25)))
        want = edit_distance(item, text)
        assert decontaminate.myers(item, text, 99)[0] == want
        assert decontaminate.myers(item, text, want - 1)[1] == -1


def test_matcher_equals_brute_force():
    r = random.Random(8)
    items = [(i, helpers.prose(100 + i, 8 + i)) for i in range(8)]
    match = decontaminate.Matcher(items)
    for seed in range(40):
        item = items[seed % 8][1]
        noisy = list(item)
        for _ in range(r.randint(0, 6)):
            noisy[r.randrange(len(noisy))] = r.choice("xyz ")
        text = decontaminate.normalise(helpers.prose(seed, 30) + " " + "".join(noisy) + " " + helpers.prose(seed + 1, 30))
        want = {(i, d) for i, t in items if (d := edit_distance(decontaminate.normalise(t), text)) <= decontaminate.budget_of(t)}
        found = match(text)
        assert {(i, e) for i, e, _, _ in found} == want
        for i, e, a, b in found:
            assert edit_distance(text[a:b], dict(items)[i]) <= e or e <= decontaminate.budget_of(dict(items)[i])


def test_decontamination_rows(spark):
    items = spark.createDataFrame([(1, helpers.prose(1, 30), 0), (2, "", 0), (3, None, 0), (None, "the of", 0), (4, "seven", 0), (1, "the harbour is quiet tonight over the copper bridge", 0)], "item_id long, text string, doc_id int")
    docs = helpers.documents(spark, [*helpers.edge_rows(), (20, "Seventeen seven."), (21, "seventeen")])
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, items).collect()}
    assert {(4, 1, 0), (5, 1, 0), (None, 1, 0), (20, 4, 0)} <= got and not any(d in (1, 2, 3, 21) for d, _, _ in got)
    two = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(docs, items, block_chars=1).collect()}
    assert two == got
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {1, 2, 3, 8, 21} <= {r.doc_id for r in kept.collect()} and {4, 5, 20}.isdisjoint({r.doc_id for r in kept.collect()})
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.clean(helpers.empty(spark), items).count() == 0


def brute_removed(rows):
    out = []
    for doc_id, text in rows:
        data = (text or "").encode("utf-8", "replace")
        covered = np.zeros(len(data), dtype=bool)
        if doc_id is not None:
            smaller = {(t or "").encode()[k : k + 50] for i, t in rows if i is not None and i < doc_id for k in range(len((t or "").encode()) - 49)}
            for k in range(len(data) - 49):
                if data[k : k + 50] in smaller:
                    covered[k : k + 50] = True
        kept = np.frombuffer(data, dtype=np.uint8)[~covered].tobytes()
        out.append((doc_id, len(data), int(covered.sum()), int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    r = random.Random(4)
    base = [helpers.prose(i, 60) for i in range(5)]
    rows = []
    for i in range(25):
        parts = [base[r.randrange(5)][r.randrange(100) :][: r.randint(30, 260)] for _ in range(3)]
        rows.append((r.randrange(40), " ".join(parts) + ("é" * r.randint(0, 60))))
    rows += [(50, "a" * 300), (51, "b" + "a" * 120), (52, base[0][:49]), (53, base[0][:50]), (None, base[0]), (54, None), (55, ""), (50, "a" * 300)]
    rows += [(56, "ab" * 200), (57, "x" + "ab" * 90), (58, helpers.prose(77, 30) + "abab" * 40), (59, None), (59, "a" * 80), (60, base[1]), (60, base[1] + base[2])]
    for hot_runs in (repeats.HOT_RUNS, 1):  # the second divides every anchor by its sides
        got = sorted((tuple(x) for x in repeats.removed(helpers.documents(spark, rows), hot_runs).collect()), key=str)
        assert got == brute_removed(rows)
    flat = [(1, "x" + "a" * 60_000), (2, "a" * 90_000), (3, "ab" * 30_000 + "a" * 200), (4, "a" * 60)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.removed(helpers.documents(spark, flat)).collect()}
    assert got == {1: (0, 0), 2: (90_000, 1), 3: (200, 1), 4: (60, 1)}
    assert repeats.removed(helpers.empty(spark)).count() == 0


def test_long_documents_are_cut_into_segments(monkeypatch):
    text = [helpers.prose(3, 900).encode()]
    whole = [tuple(map(int, x)) for part in repeats.document_runs(text) for x in zip(part[1], part[2], part[3])]
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    cut = [tuple(map(int, x)) for part in repeats.document_runs(text) for x in zip(part[1], part[2], part[3])]
    assert sum(n for *_, n in whole) == sum(n for *_, n in cut) == len(text[0]) - 49
    assert {h for h, *_ in whole} == {h for h, *_ in cut}


def test_runs_of_one_character_and_shared_lines_stay_small():
    flat = list(repeats.document_runs([b"a" * 100_000, b"ab" * 50_000]))
    assert sum(len(p[0]) for p in flat) < 10 and sum(len(p[4]) for p in flat) < 200
    line = helpers.prose(5, 40).encode()
    texts = [f"{i} ".encode() + line for i in range(500)]
    doc, h, first, count, run, left, right = (np.concatenate(x) for x in zip(*repeats.document_runs(texts)))
    sent = (h[run] << np.uint64(24)) | (repeats._bits(left) << np.uint64(12)) | repeats._bits(right)
    known, kept = repeats._combined(sent, doc[run], np.zeros(len(run), dtype=np.int64))
    assert known.mean() > 0.8 and len(kept) < len(run) / 5  # a batch sends two rows for each passage, and what is a document's own


def test_maximal_repeats_with_all_occurrences():
    r = random.Random(2)
    for _ in range(60):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 14))).encode() for _ in range(4)]
        data, starts = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts[:-1]])
        got = {}
        for length, at in repeats.maximal_repeats(data, starts, 2):
            got[bytes(data[at[0] : at[0] + length])] = sorted(at.tolist())
        want = {}
        subs = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 2, len(t) + 1)}
        for s in subs:
            places = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - len(s) + 1) if t[i : i + len(s)] == s]
            lefts = {texts[k][i - 1 : i] if i else (k, "start") for k, i in places}
            rights = {texts[k][i + len(s) : i + len(s) + 1] or (k, i, "end") for k, i in places}
            if len(places) > 1 and len(lefts) > 1 and len(rights) > 1:
                want[s] = sorted(int(starts[k]) + i for k, i in places)
        assert got == want


def test_fast_and_whole_encoding_agree():
    e = Encoder(TOKENIZER)
    assert e.fast
    r = random.Random(1)
    signs = "ab Cé'sdtrevml12½ \n\t\r.,!«ß́字\xa0\x85<|endoftext|>"
    for _ in range(2000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 25))) + "<|endoftext|>x" * (r.random() < 0.1)
        assert np.array_equal(e.whole(text), e(text)), repr(text)


def test_word_table_is_bounded(monkeypatch):
    from lodestack.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    e = Encoder(TOKENIZER)
    for i in range(20):
        t = helpers.prose(i, 8) + f" w{i}"
        assert np.array_equal(e(t), e.whole(t)) and len(e.words) <= 30


def test_token_files_round_trip(spark):
    rows = [(r[0], r[1]) for r in helpers.edge_rows()]
    got = sorted(tuple(x) for x in tokenfile.round_trip(helpers.documents(spark, rows), TOKENIZER).collect())
    want, start = [], 0
    for doc_id, text in sorted((i, t or "") for i, t in rows if i is not None):
        ids = np.append(encoder(TOKENIZER).whole(text), np.uint32(0)).astype("<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    for size in ({"file_tokens": 50}, {"file_docs": 2}):  # files cut by tokens, by documents
        assert sorted(tuple(x) for x in tokenfile.round_trip(helpers.documents(spark, rows), TOKENIZER, **size).collect()) == sorted(want)
    folder = new_path(spark, "tokens")
    files = tokenfile.write(helpers.documents(spark, rows).coalesce(1), TOKENIZER, folder, file_docs=2).collect()
    assert all(f.n_docs <= 2 for f in files) and sum(f.n_docs for f in files) == len(want) and len({f.file for f in files}) == len(files)
    assert tokenfile.round_trip(helpers.empty(spark), TOKENIZER).count() == 0


def test_reader_decompresses_only_what_is_asked_and_checks_it():
    import io

    stream = io.BytesIO()
    w = tokenfile.Writer(stream, frame_tokens=10)
    docs = [np.arange(n, dtype="<u4") for n in (4, 4, 4, 0, 25, 1)]
    for i, d in enumerate(docs):
        w.add(i * 10, d)
    w.close()
    data = stream.getvalue()
    r = tokenfile.Reader(io.BytesIO(data), len(data))
    assert len(r.frames) == 4 and list(r.docs) == [0, 10, 20, 30, 40, 50]
    seen = []
    original = r._at
    r._at = lambda a, n: seen.append((a, n)) or original(a, n)
    assert np.array_equal(r.document(4), docs[4]) and seen == [(int(r.at[2]), int(r.frames[2][0]))]
    assert all(np.array_equal(r.document(i), d) for i, d in enumerate(docs))
    import zstandard

    out = b"".join(zstandard.ZstdDecompressor().decompress(data[int(a) : int(a + n)]) for a, n in zip(r.at, r.frames[:, 0]))
    assert np.array_equal(np.frombuffer(out, "<u4"), np.concatenate(docs))  # any reader of the format can
    broken = bytearray(data)
    broken[-10] ^= 1  # a checksum in the seek table
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.Reader(io.BytesIO(bytes(broken)), len(broken)).document(5)


def brute_cost(at, cost, size):
    powers = {1 << b for b in range(30) if 1 << b < size} | {size}
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            n = at[i] - at[j]
            if n <= size:
                best[i] = min(best[i], best[j] + (0 if n in powers else size - n) + cost[i])
    return best[-1]


def test_cuts_are_the_cheapest():
    r = random.Random(6)
    for _ in range(200):
        at = np.cumsum([0] + [r.randint(1, 9) for _ in range(r.randint(1, 30))])
        cost = np.array([r.choice([0.0, 2.0, 12.0]) for _ in at])
        cost[-1] = 0
        chosen = packing.cuts(at, cost, 16)
        price = sum((0 if b - a in (1, 2, 4, 8, 16) else 16 - (b - a)) + cost[list(at).index(b)] for a, b in zip(chosen, chosen[1:]))
        assert chosen[0] == 0 and chosen[-1] == at[-1] and max(np.diff(chosen)) <= 16
        assert price == pytest.approx(brute_cost(at.tolist(), cost.tolist(), 16))


def check_packing(rows, texts):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padded = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        length = sum(p.length for p in pieces)
        assert 0 < length <= 2048
        padded, total = padded + packing.padding(length), total + length
    got = {}
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.start)):
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.append(encoder(TOKENIZER).whole(text or ""), np.uint32(1)).astype("<u4")
        at = 0
        for p in got[doc_id]:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    return padded / total


def test_packing_rows(spark):
    rows = [(i, helpers.prose(i, 50 + 37 * i % 900).replace(" quiet", ". Quiet")) for i in range(150)] + [(1000, None), (1001, ""), (1002, "x" * 40_000), (None, "y")]
    out = packing.sequences(helpers.documents(spark, rows).coalesce(1), TOKENIZER).collect()
    assert check_packing(out, dict(rows)) < 0.01
    for parts in (8, 64, 211):  # padding does not follow the partitions
        dealt = helpers.documents(spark, rows).repartition(parts)
        assert check_packing(packing.sequences(dealt, TOKENIZER).collect(), dict(rows)) < 0.01
    assert packing.sequences(helpers.empty(spark), TOKENIZER).count() == 0
    same = packing.sequences(helpers.documents(spark, [(1, "a b c"), (1, "a b c")]).coalesce(1), TOKENIZER, with_ids=True).collect()
    assert len(same) == 2 and same[0].ids == same[1].ids


def test_quality(spark):
    good = [(i, helpers.prose(i, 80), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + r for w, r in zip(helpers.prose(i, 80).split(), "*** %%% !!".split() * 30)), 0) for i in range(75)]
    bad += [(2000 + i, (helpers.WORDS[i % 20] + " ") * 90, 0) for i in range(75)]
    docs = helpers.documents(spark, [(i, t) for i, t, _ in good + bad])
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in good + bad] + [(None, 1, ""), (5, None, ""), (99999, 1, "")], "doc_id long, quality int, text string")
    weights = quality.train(docs, labels)
    out = {r.doc_id: r for r in quality.scores(docs, weights).collect()}
    truth = {i: y for i, _, y in good + bad}
    held = [r for r in out.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values()) and len(held) > 20
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    edge = quality.scores(helpers.documents(spark), weights).collect()
    assert len(edge) == len(helpers.edge_rows()) and all(r.score is not None for r in edge)
    assert quality.scores(helpers.empty(spark), weights).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.scores(docs.limit(5), none).collect()} == {0.5}
    kept = quality.accepted(docs, weights)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out.values())


def test_fit_equals_updates_one_by_one():
    r = random.Random(14)
    rows = []
    for _ in range(40):
        where = sorted(r.sample(range(30), 5))
        rows.append((np.array(where), np.array([r.random() for _ in where]), r.randrange(2)))
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * quality.L1 - z[i]) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for where, x, y in rows:
            values = {**dict(zip(where.tolist(), x.tolist(), strict=True)), 1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in values.items())))
            for i, v in values.items():
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.fit(rows)
    want = np.zeros((1 << quality.BITS) + 1)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-6) and np.count_nonzero(got) > 10


def test_features_are_the_shares_of_the_ngrams():
    make = quality.Features()
    where, x = make("a b a b !! b")
    assert x @ x == pytest.approx(1.0) and len(where) == len(set(where.tolist())) and make("")[0].tolist() == [0]
    assert sorted(np.round(x**2 * 11).astype(int).tolist()) == [1, 1, 1, 1, 2, 2, 3]  # of six words and five pairs: ab twice, a twice, b three times


def test_training_uses_no_held_out_label(spark):
    rows = [(i, helpers.prose(i, 40), i % 2) for i in range(200)]
    docs = helpers.documents(spark, [(i, t) for i, t, _ in rows])
    labels = [(i, y) for i, _, y in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (quality.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a, b)


def brute_licences(rows, threshold=0.8):
    out = {}
    for doc_id, text in rows:
        text = text or ""
        passages = [" ".join(licences.words_of(u)) for u in {*text.split("\n"), *re.split(r"\n[\x20\t\r]*\n", text), text}]
        words = licences.words_of(text)
        for name, templates in licences.TEMPLATES.items():
            for t in templates:
                b, n = licences.bigrams_of(t), len(licences.words_of(t))
                for u in passages + [" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if " ".join(words[i : i + 2]) in b]:
                    a = licences.bigrams_of(u)
                    dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                    if dice >= threshold:
                        out[doc_id, name] = max(out.get((doc_id, name), 0), round(dice, 6))
    return out


def test_licences_equal_brute_force(spark):
    apache, mit, bsd = licences.TEMPLATES["Apache-2.0"], licences.TEMPLATES["MIT"][2], licences.TEMPLATES["BSD-2-Clause"][1]
    cut = mit.split(". ")
    code = "\n".join(f"x{i} = f(x{i + 1}) or the {i}" for i in range(200))
    rows = [(1, None), (2, ""), (3, "prose\nLicensed under the Apache License, Version 2.0.\nmore"), (4, apache[1].replace(" you ", "\nyou ")), (5, "title\n\n" + mit.replace(", to any", "\nto any") + "\n\nend"),
            (6, "\n\n".join(cut)), (7, mit.upper()), (8, "released under license"), (9, "This work is licensed under GNU General Public License version 3"), (10, helpers.prose(1, 3000)), (11, "MIT"), (12, "Licensed under CC BY-NC 4.0. " * 3),
            (13, code + "\n\n" + "\n\n".join(cut) + "\n\n" + code), (14, "It was released under the MIT License, see the file for details of it."), (15, code + bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ") + code),
            (16, "// SPDX-License-Identifier: MIT */ int main"), (17, bsd.replace("software", "program").replace("copyright", "").lower()), (None, "Released under the MIT License."), (None, "x")]
    got = {(r.doc_id, r.licence): r.dice for r in licences.matches(helpers.documents(spark, rows)).collect()}
    assert got == pytest.approx(brute_licences(rows))
    assert {(3, "Apache-2.0"), (4, "Apache-2.0"), (5, "MIT"), (6, "MIT"), (7, "MIT"), (13, "MIT"), (14, "MIT"), (15, "BSD-2-Clause"), (16, "MIT"), (None, "MIT")} <= set(got)
    assert licences.matches(helpers.documents(spark)).count() == 0 and licences.matches(helpers.empty(spark)).count() == 0


def test_licence_triggers_cannot_be_avoided():
    r = random.Random(9)
    words = set(licences.triggers())
    for templates in licences.TEMPLATES.values():
        for t in templates:
            kept = [w for w in licences.words_of(t) if w not in words]
            for _ in range(20):
                sample = [w for w in kept if r.random() < 0.9]
                a, b = licences.bigrams_of(" ".join(sample)), licences.bigrams_of(t)
                assert not a or 2 * len(a & b) / (len(a) + len(b)) < 0.8 - 1e-9


def test_licence_plan_is_native(spark):
    plan = licences.matches(helpers.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def test_similar_documents_link_by_five_word_shingles(spark):
    r = random.Random(3)
    rows = []
    for c in range(12):
        words = helpers.prose(c, 300).split()
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 40):  # two near copies and a text that shares a part
            copy = list(words)
            for _ in range(edits):
                copy[r.randrange(300)] = f"w{r.randrange(999)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, rows[0][1]), (901, None), (902, ""), (903, "two words"), (904, "two words"), (None, rows[0][1])]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(helpers.documents(spark, rows)).collect()}
    for c in range(12):
        near = [i for i in range(4 * c, 4 * c + 4) if len(shingles(rows[i][1]) & shingles(rows[4 * c][1])) / len(shingles(rows[i][1]) | shingles(rows[4 * c][1])) >= 0.85]
        assert len(near) >= 3 and all(got[i] == 4 * c for i in near)
        assert got[4 * c + 3] == 4 * c + 3
    assert (got[900], got[901], got[902], got[903], got[904]) == (0, 901, 901, 903, 903) and None not in got
    assert simhash.similar_documents(helpers.empty(spark)).count() == 0


def test_ids_with_several_texts_are_linked_by_their_texts(spark):
    a, b, c = (" ".join(f"{w}{k}" for w in helpers.prose(k, 80).split()) for k in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (5, b), (5, c + " more")]
    docs = helpers.documents(spark, rows)
    got = sorted((x.doc_id, x.component_id, x.kept) for x in simhash.similar_documents(docs).collect())
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (9, 5, False), (5, 5, True), (5, 5, True)])
    got = sorted((x.doc_id, x.component_id) for x in simhash.near_duplicates(docs).collect())
    near = bin(simhash.fingerprint(c) ^ simhash.fingerprint(c + " more")).count("1") <= 3
    assert got == sorted([(1, 1), (5, 1), (5, 5), (7, 5), (5, 5), (9, 5 if near else 9), (5, 5)])


def test_sketches_estimate_similarity():
    words = helpers.prose(1, 3000).split()
    for cut in (100, 600, 1500):
        a, b = " ".join(words), " ".join(words[cut:])
        truth = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        x, y = (np.frombuffer(simhash.sketch(t), "<u8") for t in (a, b))
        assert abs(1 - 2 * np.bitwise_count(x ^ y).sum() / simhash.SKETCH - truth) < 0.1


def test_contiguous_edits_stay_near_duplicates(spark):
    r = random.Random(11)
    vocabulary = [f"{w}{i}" for w in helpers.WORDS for i in range(40)]

    def text(n):
        return [r.choice(vocabulary) for _ in range(n)]

    rows, near = [], []
    for c in range(60):
        words = text(r.randint(100, 600))
        n = len(words)
        cut = words[: n - n // 8] if c % 2 else words + text(n // 8)
        rows += [(2 * c, " ".join(words)), (2 * c + 1, " ".join(cut))]
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        near.append(len(a & b) / len(a | b))
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(helpers.documents(spark, rows)).collect()}
    assert min(near) > 0.85 and all(got[2 * c] == got[2 * c + 1] == 2 * c for c in range(60))


def sketch_rows(seed, groups):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(40):
        sketch = rng.integers(0, 1 << 63, 16, dtype=np.uint64)
        for _ in range(5):
            rows.append((i * groups // 40, sketch.copy()))
            sketch[rng.integers(16)] ^= np.uint64(rng.integers(1, 1 << 62))
    bits = {(a, b): int(np.bitwise_count(rows[a][1] ^ rows[b][1]).sum()) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0]}

    def joined(links):
        label = np.arange(len(rows))
        simhash.unite(label, np.array([a for a, b in links], dtype=int), np.array([b for a, b in links], dtype=int))
        return label.tolist()

    return rows, bits, joined


def test_large_groups_link_like_small_ones(monkeypatch):
    import pyarrow as pa

    rows, bits, joined = sketch_rows(4, 2)
    n = len(rows)
    columns = {"cell": [k for k, _ in rows], "key": [k for k, _ in rows], "side": [0] * n, "rep": range(n), "kind": range(n)}
    batch = pa.RecordBatch.from_arrays([*(pa.array(v) for v in columns.values()), pa.array([s.tobytes() for _, s in rows], pa.binary())], names=[*columns, "sketch"])
    sure = joined([p for p, d in bits.items() if d <= 40])
    doubtful = {x for p, d in bits.items() for x in p if 40 < d <= 110 and sure[p[0]] != sure[p[1]]}
    for bulk, step in ((1000, 200), (1, 7), (1, 30)):
        monkeypatch.setattr(simhash, "BULK_GROUP", bulk)
        out = [x for b in simhash._compared(40, 110)(batch.slice(i, step) for i in range(0, 200, step)) for x in b.to_pylist()]
        assert joined([(x["src"], x["dst"]) for x in out if x["key"] is None]) == sure
        assert [x["kind"] for x in out if x["key"] is not None] and {x["kind"] for x in out if x["key"] is not None} == doubtful


@pytest.mark.parametrize("cell_rows", [5, 37, 1000])
def test_cells_lose_no_link(spark, cell_rows):
    rows, bits, joined = sketch_rows(5, 3)
    shared = spark.createDataFrame([(k, i, i) for i, (k, _) in enumerate(rows)], "key long, rep long, kind long")
    sketches = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, (_, s) in enumerate(rows)], "kind long, sketch binary")
    out = simhash._met(shared, sketches, 40, 110, cell_rows).collect()
    sure = joined([p for p, d in bits.items() if d <= 40])
    assert joined([(x.src, x.dst) for x in out if x.key is None]) == sure
    doubtful = {x for p, d in bits.items() for x in p if 40 < d <= 110 and sure[p[0]] != sure[p[1]]}
    assert doubtful <= {x.kind for x in out if x.key is not None}


def test_similarity_at_the_threshold_is_exact(spark):
    r = random.Random(12)
    rows, want = [], {}
    for c in range(150):
        words = [f"{r.choice(helpers.WORDS)}{r.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        kept = r.choice([154, 156, 158, 159, 160, 160, 161, 162])  # of them: 160 are a similarity of 0.8
        rows += [(2 * c, " ".join(words)), (2 * c + 1, " ".join(words[: kept + 4]))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * c] = 2 * c
        want[2 * c + 1] = 2 * c if len(a & b) / len(a | b) >= 0.8 else 2 * c + 1
    hub = [f"h{i}" for i in range(204)]  # a large group around the threshold, its members linked only through the hub
    rows += [(1000, " ".join(hub))] + [(1001 + i, " ".join(hub[: 160 + i % 2 * 4] + [f"x{i}"])) for i in range(80)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(helpers.documents(spark, rows)).collect()}
    assert got == {x.doc_id: x.component_id for x in simhash.similar_documents(helpers.documents(spark, rows), cell_rows=8, cell_sets=5).collect()}
    assert {i: got[i] for i in want if i < 1000} == {i: c for i, c in want.items() if i < 1000}
    sets = {i: shingles(t) for i, t in rows if i >= 1000}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if label[a] != label[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert {i: got[i] for i in label} == label


@pytest.mark.parametrize(
    "disguise",
    ["192 dot 168 dot 0 dot 1", "192 [dot] 168 [dot] 1 [dot] 20", "192.168.one.one", "one nine two dot one six eight dot zero dot one", "192 dot 168 dot one dot 1",
     "one nine two.one six eight.0.one", "one dot 2 dot three dot 4", "eins punkt zwei punkt drei punkt fünf", "10 (dot) zero (dot) zero (dot) 7", "192.168 dot one.one"],
)
def test_disguised_addresses(disguise):
    text = f"host: {disguise} is up"
    assert pii.detect(text) == [] and pii.joined(pii.disguised(text, [])) == f"ip:6:{6 + len(disguise)}"
    assert pii.redact(text, pii.disguised(text, [])) == "host: [IP] is up"


@pytest.mark.parametrize(
    "names",
    ["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "null eins zwei drei vier fuenf sechs sieben acht neun",
     "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"],
)
def test_all_digit_names(names):
    assert pii.Rewritten(names).text == "0123456789"
    text = f"call plus {names} now"
    assert pii.joined(pii.disguised(text, pii.detect(text))) == f"phone:5:{len(text) - 4}"
    d = names.split()
    card = ".".join([d[4], *[d[1]] * 15])  # dots in a spelled card number are still left out
    assert pii.joined(pii.disguised(card, pii.detect(card))).endswith(f"card:0:{len(card)}")
