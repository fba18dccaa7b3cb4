"""Row-wise and corpus-wide text operators against plain restatements of their contracts."""

import base64
import gzip
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import pytest
from conftest import no_rows, rows_of, texts_of

from ledgerlark.llm import bpe, decontaminate, exact, language_model, personal_data, secret_scan, substrings

SPACE = "\x20\t\n\x0b\x0c\r"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)


def same(df, expected, *columns):
    assert sorted(rows_of(df, *columns), key=repr) == sorted(expected, key=repr)


@pytest.fixture(params=["awkward", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


def plain_secrets(t):
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_secrets(docs):
    want = []
    for i, t in texts_of(docs):
        base = plain_secrets(t)
        n = Counter(k for k, _, _ in base)
        want.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))))
    got = secret_scan.scan_secrets(docs)
    same(got, want, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert no_rows(got).columns == got.columns and secret_scan.scan_secrets(no_rows(docs)).count() == 0


def test_secrets_below_layers():
    inner = "password=hunter2hunter2"
    nested = base64.b64encode(gzip.compress(base64.b64encode(inner.encode()))).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in inner)
    for token in (quote(inner, safe=""), quote(quote(inner, safe=""), safe=""), base64.b64encode(inner.encode()).decode(), nested, escaped, quote(escaped), "".join(f"&#{ord(c)};" for c in inner)):
        text = f"é before {token} after"
        base, found, layers, refused = secret_scan.secrets(text)
        assert layers and not refused
        spans = [(a, b) for k, a, b in found if k == "assign"]
        assert any(a >= 9 and b <= 9 + len(token) for a, b in spans), (token, found)
    exact_place = secret_scan.secrets("x " + base64.b64encode(b"hello token: abcdefgh bye").decode())[1]
    assert exact_place and all(2 + 8 <= a and b <= 2 + 29 for _, a, b in exact_place)
    bomb = base64.b64encode(zlib.compress(b"a" * 50_000_000)).decode()
    assert secret_scan.secrets(bomb)[3] == 1
    loop = "%25" * 2000
    assert secret_scan.secrets(loop)[2] >= 1


def test_secrets_in_glued_damaged_and_large_layers():
    inner = b"password=hunter2hunter2"
    token = base64.b64encode(inner).decode()

    def spans(text):
        return {(a, b) for k, a, b in secret_scan.secrets(text)[1] if k == "assign"}

    for before, after in (("a/" + "segment-" * 9, ""), ("", "/download"), ("", "_v2-final"), ("x_y/" * 40, "-a_b" * 40), ("k_", "/" + token)):
        at = len(before)
        assert (at, at + len(token.rstrip("="))) in spans(f"{before}{token.rstrip('=')}{after}"), (before, after)
    for odd in ("\u00a0", "\u200b", "\u00ad", "\f", "\v", "\0"):
        raw = f"note{odd} ".encode() + inner
        for packed in (raw, gzip.compress(raw), zlib.compress(raw)):
            assert spans("see " + base64.b64encode(packed).decode()), (odd, packed)
    for packed in (b"caf\xe9 " + inner, gzip.compress(b"caf\xe9 " + inner)):
        assert spans(base64.b64encode(packed).decode())
    assert spans("%FF" + quote(inner.decode(), safe="").replace("=", "%3D")) and spans("%70%61%73%73%77%6F%72%64%3D%68%75%6E%74%65%72%32%FF")
    glued = base64.b64encode(gzip.compress(inner)).decode().rstrip("=")
    assert spans(f"a-{glued}/raw") == {(2, 2 + len(glued))}
    # Twice the same token: both places; a layer beyond the budget is read to its end.
    assert len(spans(f"{token} and {token}")) == 2
    large = base64.b64encode(gzip.compress(gzip.compress(b"some words " * 1_000_000 + inner))).decode()
    assert spans(large) and secret_scan.secrets(large, 1 << 20)[1:4:2] == (secret_scan.secrets(large)[1], 1)


def test_secrets_below_layers_that_begin_alike_or_hold_text_beside():
    def found(raw):
        text = "x " + base64.b64encode(raw).decode()
        return {(a, b) for k, a, b in secret_scan.secrets(text)[1] if k == "assign"}

    def split(whole):
        return gzip.compress(whole[:10], mtime=0) + gzip.compress(whole[10:], mtime=0)

    raw = gzip.compress(b"see password=abcdefgh12 there", mtime=0)
    for _ in range(4):  # every layer inflates to the same ten bytes first
        raw = split(raw)
        assert found(raw), len(raw)
    # Behind or in front of what is compressed in a layer, and in a layer that only looks compressed.
    assert found(gzip.compress(zlib.compress(b"nothing to see") + b" password=abcdefgh12 "))
    assert found(gzip.compress(gzip.compress(b"nothing")[:-4] + b"\npassword=abcdefgh12"))
    # A layer too large for the budget is followed downwards as well, and lost to no charge of the layers above it.
    noise = random.Random(5).randbytes(300_000)
    deep = gzip.compress(gzip.compress(noise + b"\npassword=abcdefgh12\n" + noise), mtime=0)
    text = "x " + base64.b64encode(deep).decode()
    whole = secret_scan.secrets(text)[1]
    assert secret_scan.secrets(text, 700_000)[1] == whole and secret_scan.secrets(text, 1000)[1] and any(k == "assign" for k, _, _ in whole)


def test_secrets_below_many_escapes():
    import random
    from urllib.parse import quote

    rng = random.Random(11)
    for _ in range(200):
        plain = "é token=" + "".join(rng.choice("abcxyz0189") for _ in range(8)) + " %zz"
        text, kinds = plain, rng.choices(("percent", "unicode", "html"), k=rng.randint(1, 9))
        for kind in kinds:
            text = quote(text) if kind == "percent" else "".join(f"\\u{ord(c):04x}" if c in "%&\\; é=" else c for c in text) if kind == "unicode" else "".join(f"&#{ord(c)};" if c in "%&\\ é=" else c for c in text)
        found = secret_scan.secrets(text)[1]
        assert any(kind == "assign" and a <= text.find("token") and b > text.find("token") + 5 for kind, a, b in found), (kinds, text)
    # Escapes of escapes cost their length.
    for text in ("%" + "25" * 200_000 + "3D", "password%" + "25" * 100_000 + "3Dhunter2hunter2", "\\" + "u005c" * 50_000 + "u0041", "&#38;" + "#38;" * 50_000):
        assert secret_scan.secrets(text)[2] <= 8
    settled = secret_scan._settled(("a%25252541\\u005cx42%C3%A9&#x26;#67;", None, None))
    assert settled[0] == "aABéC" and list(settled[1]) == [0, 1, 10, 19, 25] and list(settled[2]) == [1, 10, 19, 25, 35]


def plain_personal(t):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "phone" and 9 <= len(d) <= 15:
                found.append((kind, m.start(), m.end()))
            if kind == "card" and 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
                found.append((kind, m.start(), m.end()))
    return found


def test_personal(docs):
    want = []
    for i, t in texts_of(docs):
        base = plain_personal(t)
        n = Counter(k for k, _, _ in base)
        want.append((i, *(n[k] for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))))
    got = personal_data.find_personal(docs)
    same(got, want, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert personal_data.find_personal(no_rows(docs)).count() == 0


def test_personal_edges():
    import random

    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("a1.2@_%-+ 5(") for _ in range(rng.randint(0, 30)))
        assert personal_data.base_spans(t) == plain_personal(t), t
    t = "pay account GB82 WEST 1234 5698 7654 32 or GB83 WEST 1234 5698 7654 32; 7536784127813050 4111111111111111"
    added = personal_data.added_spans(t, personal_data.base_spans(t))
    assert [k for k, _, _ in added].count("iban") == 1 and ("card", t.index("4111"), len(t)) in added
    assert personal_data.added_spans("her ssn 123-45-6789", []) == [("ssn", 8, 19)] and personal_data.added_spans("part 123-45-6789", []) == []
    # A number in front that passes by chance hides no card.
    lost = 0
    for _ in range(2000):
        card = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
        card += next(c for c in "0123456789" if personal_data.luhn(card + c))
        t = f"{rng.randint(1990, 2030)} {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"
        lost += not {("card", 5, len(t)), ("card", 0, len(t))} & {*personal_data.base_spans(t), *personal_data.added_spans(t, personal_data.base_spans(t))}
    assert lost == 0
    personal_data.added_spans("1234 " * 100_000, [])
    long = "9" * 200_000 + "a" * 200_000
    assert personal_data.base_spans(long) == []


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want, ids = [], {}
    for i, text in texts_of(docs):
        e = t.encode(text, add_special_tokens=False).ids
        ids.setdefault(i, e)
        want.append((i, len(e), sha(" ".join(map(str, e))), sha(t.decode(e, skip_special_tokens=False))))
    same(bpe.digests(docs, bpe.default_vocabulary()), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    coded = bpe.encode(docs, bpe.default_vocabulary())
    assert all(r["ids"] == ids[r["doc_id"]] for r in coded.collect())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, bpe.default_vocabulary()).collect()}
    assert all(back[i] == t.decode(e, skip_special_tokens=False) for i, e in ids.items())
    assert bpe.digests(no_rows(docs), bpe.default_vocabulary()).count() == 0


def test_bpe_long_words():
    import random

    with open(bpe.default_vocabulary(), "rb") as f:
        own = bpe.Codec(f.read())
    rng = random.Random(2)
    for _ in range(50):
        word = [own.inner[ord(rng.choice("etaoinsh"))] for _ in range(rng.randint(2, 300))]
        assert own.merge(list(word)) == own.merge_long(list(word))


def test_language_model_base(docs):
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    rows = [(i, [*words_of(lower(t)), None], zlib.crc32(str("" if i is None else i).encode()) % 10 == 0) for i, t in texts_of(docs)]
    count = Counter(w for _, ws, held in rows if not held for w in ws)
    n, v = sum(count.values()), len(count)
    got = language_model.score_documents(docs).collect()
    want = [(i, held, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws, held in rows]
    key = lambda r: (repr(r[0]), r[2])
    for g, w in zip(sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
    assert language_model.score_documents(no_rows(docs)).count() == 0


def plain_matching(train, text, order=4, symbols=257):
    """PPM with method C and exclusion, symbol by symbol, straight from its definition."""
    seen = {}
    pad = bytes([0xFE]) * order
    for t in train:
        b = pad + t + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen.setdefault(b[i - k : i], Counter())[b[i]] += 1
    total, b = 0.0, pad + text + b"\xff"
    for i in range(order, len(b)):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            node = {s: c for s, c in seen.get(b[i - k : i], {}).items() if s not in out}
            if not node:
                continue
            n, q = sum(node.values()), len(node)
            if b[i] in node:
                p *= node[b[i]] / (n + q)
                break
            p *= q / (n + q)
            out |= set(node)
        else:
            p /= symbols - len(out)
        total += math.log10(p)
    return total


def test_language_model_matching(spark):
    texts = ["the cat sat on the mat", "the cat ate the rat", "", "zebra crossing ahead", "Überall the cat", "mat on the cat", "abracadabra", "abracadabrx", "q", "the the the the", "rat mat cat", "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    low = [t.encode().lower() for t in texts]
    train = [t for i, t in enumerate(low) if zlib.crc32(str(i).encode()) % 10]
    for r in language_model.score_documents(docs).collect():
        assert math.isclose(r["score"], plain_matching(train, low[r["doc_id"]]), rel_tol=1e-9), r


def test_repeated_spans(docs):
    rows = [(i, words_of(t)) for i, t in texts_of(docs)]
    count = Counter(tuple(ws[s : s + 35]) for _, ws in rows for s in range(len(ws) - 34))
    want = []
    for i, ws in rows:
        gone = [False] * len(ws)
        for s in range(len(ws) - 34):
            if count[tuple(ws[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        want.append((i, len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g))))
    same(substrings.remove_repeats(docs), want, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert substrings.remove_repeats(no_rows(docs)).count() == 0


def test_repeated_spans_random(spark):
    """Few distinct words and pasted passages: dense branching, shifts, self-overlap."""
    import random

    rng = random.Random(3)
    passage = [[rng.choice("abcdefgh") for _ in range(rng.randint(30, 120))] for _ in range(6)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(rng.randint(1, 4)):
            ws += [str(rng.random()) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passage)
            a = rng.randint(0, 20)
            ws += p[a : rng.randint(a + 20, len(p) + 30)]
        if i % 9 == 0:
            ws += ["z"] * rng.randint(30, 60)
        rows.append((i, " ".join(ws)))
    test_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))


def test_exact_groups(docs):
    rows = texts_of(docs)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(f"[{SPACE}]", "", t), []).append((-len(t), (i is not None, i or 0), i))
    want, marked = [], set()
    for i, t in rows:
        bare = re.sub(f"[{SPACE}]", "", t)
        keep = min(groups[bare])[2]
        want.append((i, keep, len(groups[bare]), i == keep and i not in marked, sha(bare)))
        if i == keep:
            marked.add(i)
    same(exact.exact_groups(docs, digest=True), want, "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert exact.exact_groups(no_rows(docs)).count() == 0


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))


def plain_contamination(docs, items):
    windows = {}
    for k, t in items:
        ws = item_words(t)
        for s in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[s : s + 10]), set()).add(k)
    sizes = {len(w) for w in windows}
    for i, t in docs:
        ws, hit, met = item_words(t), set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                if (w := tuple(ws[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    met |= windows[w]
        yield i, len(ws), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit)


def test_contamination(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = [(900, "one two THREE four five six seven eight nine ten eleven"), (901, "lorem ipsum"), (902, "lorem ipsum"), (903, None), (904, "?"), (905, "w30 w31 w32 w33 w34 w35 w36 w37 w38")]
    items = items.select("item_id", "text").union(spark.createDataFrame(extra, "item_id long, text string"))
    known = [(r["item_id"], r["text"] or "") for r in items.collect()]
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(decontaminate.contamination(docs, items), list(plain_contamination(texts_of(docs), known)), *columns)
    assert decontaminate.contamination(no_rows(docs), items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, no_rows(items)).collect())


def test_accounts_and_cards_beside_other_words():
    def added(text):
        return [(k, text[a:b]) for k, a, b in personal_data.added_spans(text, personal_data.base_spans(text))]

    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for text, want in ((f"{de} 2024", de), (f"{gb} AND more", gb), (f"IBAN {de} {gb} X", de)):
        assert ("iban", want) in added(text), text
    assert ("iban", gb) in added(f"IBAN {de} {gb} X")
    for text, want in (("2 4111111111111111", "4111111111111111"), ("12 3782 822463 10005 7 1", "3782 822463 10005"), ("1 4111 1111 1111 1111", "4111 1111 1111 1111")):
        assert ("card", want) in added(text), text
    assert added("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20") == []


def test_rows_that_share_an_id_or_have_none(spark):
    """Only the second and third text share a passage; the item stands in the first alone."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, one), (None, f"{two} x"), (1, f"{two} y"), (1, three), (2, three + " tail"), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert removed == {(None, 60): 0, (None, 61): 60, (1, 61): 60, (1, 60): 60, (2, 61): 60, (2, 1): 0}
    items = spark.createDataFrame([(7, one)], "item_id long, text string")
    hit = sorted((r["doc_id"] is None, r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect())
    assert hit == [(False, 1, 0, 0), (False, 60, 0, 0), (False, 61, 0, 0), (False, 61, 0, 0), (True, 60, 60, 1), (True, 61, 0, 0)]
