"""Each operator against a plain version, an exact round trip or held-out accuracy, with nulls, empty texts and repeats."""

import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, decontamination, language_id, personal_data, piece_codec, substring_dedup, token_files, warc

P = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, start string, window string, unit string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in rows], DOCS).repartition(3)


TEXTS = [(5, None), (3, ""), (4, "  \n "), (1, "It's the café, don't!! 12 ²³ <|endoftext|> ▁x"), (2, "日本語 😀 Σίσυφος \x00 é"), (9, "a b " * 40_000), (7, "same"), (7, "same"), (8, "same")]


# ---- chat ---------------------------------------------------------------------------------------------------------------


def test_chat_layouts_and_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "####", "#" * 7 + "\\", "</turn></turn>\n### user: x </turn>\n", "", "a\\\\b", "émile 😀"]
    records = [(i, 0, json.dumps({"messages": [{"role": "user", "content": t}, {"role": "assistant", "content": t}]})) for i, t in enumerate(nasty)]
    records += [(100, 0, json.dumps({"instruction": "do", "input": "it", "output": "done"})), (101, 0, json.dumps({"instruction": "do", "output": "done", "system": "be"})), (102, 0, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})), (103, 0, json.dumps({"prompt": "q", "completion": "a"})), (104, 0, json.dumps({"answer": "a", "question": "q"})), (105, 0, json.dumps({"nothing": 1})), (106, 0, "no json"), (107, 0, None), (108, 0, json.dumps({"role": "a:b\\", "text": "t", "turn": 0})), (109, 0, json.dumps({"role": None, "turn": 0}))]
    df = spark.createDataFrame(records, "conv_id long, turn long, record string")
    turns = chat.canonical_turns(df)
    told = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
        told.setdefault(r.conv_id, []).append((r.role, r.text))
    assert [told[i] for i in range(len(nasty))] == [[("user", t), ("assistant", t)] for t in nasty]
    assert told[100] == [("user", "do\nit"), ("assistant", "done")] and told[101] == [("system", "be"), ("user", "do"), ("assistant", "done")]
    assert told[102] == told[103] == told[104] == [("user", "q"), ("assistant", "a")] and told[108] == [("a:b\\", "t")]
    assert not {105, 106, 107} & set(told)
    assert {r.paths for r in chat.unknown_layouts(df).collect()} >= {"nothing"}
    text = {}
    for r in sorted(chat.format_turns(turns).collect(), key=lambda r: (r.conv_id, r.turn, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.stretch
        loss = chat.unescape(r.stretch[r.loss_start : r.loss_end])
        assert loss in ("", *nasty, "done", "a")
    assert {i: chat.parse(t) for i, t in text.items()} == told
    digests = {r.conv_id: r for r in chat.turn_digests(chat.format_turns(turns)).collect()}
    for i, own in told.items():
        assert digests[i].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert digests[i].formatted_chars == len(text[i])


# ---- token files ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0] * 500, [1, 2**63, 2**64 - 1, 2**60, 2**60 - 1, 0, 0], list(range(1000)), [2**59] * 3])
def test_pack(ids):
    assert token_files.unpack(token_files.pack(np.array(ids, np.uint64))).tolist() == ids


def test_pack_random():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 11, 16, 40, 62):
        ids = rng.integers(0, 1 << bits, 3000).astype(np.uint64)
        assert (token_files.unpack(token_files.pack(ids)) == ids).all()


def test_token_files(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    target = str(tmp_path / "files")
    token_files.write_token_files(docs_of(spark, TEXTS), target, path, block_ids=500)
    library = token_files.WordTokenizer(path).library
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.token_digests(spark, target).collect()) == sorted(want)
    token_files.write_token_files(docs_of(spark, []), target + "0", path)
    assert token_files.token_digests(spark, target + "0").count() == 0


def test_a_word_of_a_batch_is_looked_up_once():
    own = token_files.WordTokenizer(P.path("word_bpe_49k.json"))
    asked, rows = [], own._words.rows
    own._words.rows = lambda words: (asked.append(len(words)), rows(words))[1]
    texts = ["", " ", "the  The the", "x" * 50 + " été\u00a0the\tthe", "\u4e2d the", "the " * 1000, ""]
    ids, counts = own.encode_batch(texts, 2)
    want = [[*own.library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
    assert asked == [4]  # nothing, the, x.., and what holds white space of another kind
    assert own.encode_batch([], 2)[0].tolist() == [] and own.encode_batch(["\u4e2d"], None)[1].tolist() == [len(own.library.encode("\u4e2d", add_special_tokens=False).ids)]


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    path = P.path("word_bpe_49k.json")
    told = json.loads(open(path).read())
    texts = [t or "" for _, t in TEXTS[:5]] + ["UPPER Case", "we'll see"]
    for change in ({"normalizer": None}, {"pre_tokenizer": told["pre_tokenizer"]["pretokenizers"][1]}, {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(told | change))
        own = token_files.WordTokenizer(str(other))
        want = own.library
        assert own.by_words == ("truncation" in change)
        ids, counts = own.encode_batch(texts)
        assert ids.tolist() == [x for t in texts for x in want.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)


# ---- pieces --------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path)
    rng = random.Random(2)
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice("ab th eing\n▁éЖ中1.,-()s ") for _ in range(rng.randrange(1, 50))) for _ in range(500)]
    want = library.encode(texts, add_bos=True, add_eos=True)
    got = own.encode_batch(texts)
    assert [g.tolist() for g in got] == want
    assert [own.decode(g) for g in got] == library.decode(want)
    odd = [[rng.choice([0, 1, 2, 198, 3 + rng.randrange(256), rng.randrange(32000)]) for _ in range(rng.randrange(7))] for _ in range(500)]
    assert [own.decode(np.array(o, np.int64)) for o in odd] == [library.decode(o) for o in odd]
    rows = piece_codec.encode_documents(docs_of(spark, TEXTS), path).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id: r.ids for r in rows}[3] == [1, 2]


# ---- personal data ---------------------------------------------------------------------------------------------------------


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and personal_data._luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1" * 5000 + ".1.1.1", "a" * 1_000_000 + "@ ", "a@" + "b" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "@" * 1_000_000, "0" * 5000 + "25.1.1.01"], ids=range(8))
def test_long_texts_take_no_long_time(text):
    import time

    began = time.perf_counter()
    personal_data.all_spans(personal_data.Tagger(personal_data.default_field()), [text])
    assert time.perf_counter() - began < 10
    if text.startswith("00"):
        assert personal_data.base_spans(text) == [("ip", 0, len(text))]


def test_secrets_have_exact_borders():
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    tagger = personal_data.Tagger(personal_data.default_field())
    for text in (f'Thst token = "{key}" elle.', f'ench*** token = "{key}"### nicht***', f'token = "{key}"die.34@mail7.example.com zu', f"x password={key}, y", f'TION!! TOKEN = "{key.upper()}"!! THE!!'):
        ((_, every),) = personal_data.all_spans(tagger, [text])
        assert [text[a:b].lower() for k, a, b in every if k == "secret"] == [key], text


def test_names_in_neither_list_and_in_other_sentences():
    tagger = personal_data.Tagger(personal_data.default_field())
    told = [
        ("please ask for Mr. Tolkar Quenby about the invoice", "Tolkar Quenby"),
        ("the letter was signed by Zofia Wrona in May", "Zofia Wrona"),
        ("hello, my name is Anselm Okafor and i call you", "Anselm Okafor"),
        ("seen by Dr. Ilse Morgan.", "Ilse Morgan"),
        ("Contact: Ravi Menon, second floor", "Ravi Menon"),
        ("we met Mrs. Petrov yesterday", "Petrov"),
        ("the patient Oyelaran Bisi has been told", "Oyelaran Bisi"),
        ("order 4471 for Customer: Mila Horvat", "Mila Horvat"),
    ]
    found = [[text[a:b] for k, a, b in every if k == "name"] for text, _ in told for ((_, every),) in [personal_data.all_spans(tagger, [text])]]
    assert sum(got == [name] for got, (_, name) in zip(found, told, strict=True)) >= 7, found
    for text in ("the Market Street is closed", "It was late. Nobody came.", "Version 2.4 of Example Software", "see https://docs.example.org/start/77 for more"):
        ((_, every),) = personal_data.all_spans(tagger, [text])
        assert not every, (text, every)


def test_personal_data(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789+-. ()@a.b%é\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "x@y.z@q.r.s", "1.2.3.4.5.6.7.8", "+1+234567890", "@@a@b.c", "+1 (467) 555-9874 and 10.0.0.256"]
    assert [personal_data.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts[-6:])] + [(50, None), (51, ""), (52, "Dear all, my name is Anna Becker. password=1a2b3c4d5e6f7a8b9c0d1e2f"), (53, "x " * 30_000)]
    got = {r.doc_id: r for r in personal_data.find_personal_data(docs_of(spark, rows)).collect()}
    assert got[0].n_card == 1 and got[5].n_phone == 1 and got[5].n_ip == 0 and got[50].spans == got[51].spans == got[53].spans == ""
    assert "name:" in got[52].spans and "secret:" in got[52].spans
    masked = {r.doc_id: r.text for r in personal_data.mask_personal_data(docs_of(spark, rows)).collect()}
    assert masked[50] is None and masked[0] == "[card]" and masked[52].startswith("Dear all, my name is [name]")


def test_field_on_held_out_sentences():
    rows = personal_data.labelled_rows(seed=99, sentences=200)
    by = {}
    for s, _, token, label in rows:
        by.setdefault(s, []).append((token, label))
    tokens, truth = [t for own in by.values() for t, _ in own], [x for own in by.values() for _, x in own]
    got = personal_data.Tagger(personal_data.default_field()).labels(tokens, np.array([len(own) for own in by.values()]))
    assert np.mean([personal_data.LABELS[g] == x for g, x in zip(got, truth, strict=True)]) > 0.98


# ---- archives --------------------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nx: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n é"), (-6, "u", "z" * 100_000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == 18
    captures = {r.capture_id: r for r in warc.assemble(records).collect()}
    own = {int(k.split(":")[-1][:-1]): c for k, c in captures.items()}
    assert all(c.request and c.response and c.metadata for c in own.values())
    assert own[1].response.record_type == "revisit" and own[1].response.refers_to.endswith(":2>") and own[3].response.refers_to.endswith(":4>")
    assert bytes(own[5].response.block).decode() == rows[4][2] and own[-6].response.payload_bytes == 100_000
    assert own[2].response.payload_digest == warc.payload_digest(b"<p>x</p>")


def test_archives_keep_pages_that_share_an_id(spark, tmp_path):
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "two"), (2, "v", "two"), (None, "u", "one"), (None, "u", "three"), (None, "v", "three"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert all(c.request and c.response and c.metadata for c in captures)
    two = warc.payload_digest(b"two")
    told = sorted((c.response.target_uri, c.response.payload_digest, c.response.record_type) for c in captures)
    want = {(i, u or "", warc.payload_digest((h or "").encode()), "revisit" if (i, h) == (1, "two") else "response") for i, u, h in rows}
    assert told == sorted(x[1:] for x in want) and len(captures) == 7
    by = {c.capture_id: c.response for c in captures}
    assert [by[r.refers_to].target_uri for r in by.values() if r.record_type == "revisit"] == ["v"] and f"<urn:capture:response:{two}:2>" in by


def test_archives_of_others(spark, tmp_path):
    import gzip

    def record(headers, block, end="\r\n"):
        return ("WARC/1.0" + end + "".join(f"{k}{v}{end}" for k, v in headers) + f"content-length:{len(block)}{end}{end}").encode() + block + (end * 2).encode()

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    a = record([("WARC-Type:", "warcinfo"), ("WARC-Record-ID: ", "<i>")], b"software: x")
    b = record([("WARC-Type: ", "response"), ("WARC-Record-ID:", "<r>"), ("WARC-Target-URI :", " http://a/?q=a:b"), ("WARC-Note: ", "one\r\n  two"), ("Content-Type: ", "application/http; msgtype=response")], http + b"\x00WARC/1.0\r\n\r\n" * 3)
    c = record([("WARC-Type: ", "revisit"), ("WARC-Record-ID: ", "<v>"), ("WARC-Refers-To: ", "<r>"), ("WARC-Payload-Digest: ", "md5:00")], b"", "\n")
    d = record([("WARC-Type: ", "resource"), ("WARC-Record-ID: ", "<x>"), ("Content-Type:", "text/plain")], "é".encode() * 500_000)
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, (a, b))))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(c + d) + b"\0" * 16)
    rows = {r.record_id: r for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {"<i>", "<r>", "<v>", "<x>"}
    body = b"\x00WARC/1.0\r\n\r\n" * 3
    assert bytes(rows["<r>"].block) == body and rows["<r>"].payload_digest == warc.payload_digest(body) and rows["<r>"].target_uri == "http://a/?q=a:b"
    assert rows["<v>"].refers_to == "<r>" and bytes(rows["<v>"].block) == b"" and len(rows["<x>"].block) == 1_000_000
    captures = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert captures["<r>"].response and captures["<v>"].response.record_type == "revisit"
    assert list(warc.parse_records(a + b))[1][0]["warc-note"] == "one two"
    for bad in (b"x", a[:-20], gzip.compress(b)[:-30], record([("WARC-Type", "no colon")], b"")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.parse_records(bad))
    wrong = record([("WARC-Type: ", "response"), ("WARC-Record-ID: ", "<r>"), ("WARC-Payload-Digest: ", "sha1:AAAA")], http)
    (tmp_path / "wrong").mkdir()
    (tmp_path / "wrong" / "w.warc.gz").write_bytes(gzip.compress(wrong))
    with pytest.raises(Exception, match="differ"):
        warc.read_records(spark, str(tmp_path / "wrong")).count()
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


# ---- decontamination ---------------------------------------------------------------------------------------------------------


def plain_contamination(docs, benchmark):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in benchmark:
        w = words(text)
        for i in range(len(w) - min(len(w), 10) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + min(len(w), 10)]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 25, 64])
def test_contamination(spark, most):
    long = " ".join(f"w{i}" for i in range(14))
    bench = [(1, long), (2, "Short one"), (3, None), (4, "...!"), (1, long), (10, " ".join(f"w{i}" for i in range(2, 14))), (11, "ünï 5")]
    docs = [*TEXTS, (20, f"x {long.upper()}, y"), (21, "a short, ONE short one"), (22, "w0 w1 w2 w3 w4 w5 w6 w7 w8 W9"), (23, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (24, "Ünï 5 ünï-5"), (25, f"{long} {long}")]
    b = spark.createDataFrame([(i, t, "q") for i, t in bench], "item_id long, text string, doc_id string")
    d = docs_of(spark, docs)
    got = decontamination.contamination(d, b, most)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == plain_contamination(docs, bench)
    clean = sorted(x[0] for x in plain_contamination(docs, bench) if not x[5])
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(d, b, most).collect()) == clean
    cut = {r.doc_id: r.text for r in decontamination.cut_contaminated(d, b, most).collect()}
    assert cut[20] == "x y" and cut[23] == docs[-3][1] and cut[21] == "a "
    assert decontamination.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(d.limit(0), b).count() == 0


@pytest.mark.parametrize("most", [1 << 25, 64])
def test_contaminated_rows_are_judged_one_by_one(spark, most):
    long = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, long), (2, "short one")], "item_id long, text string")
    rows = [(None, f"x {long}"), (None, "clean"), (7, f"x {long.upper()}, y"), (7, "clean too"), (8, "a short, ONE short one"), (9, None), (10, "")]
    d = docs_of(spark, rows)
    key = lambda r: (str(r[0]), str(r[1]))
    clean = [r for i, r in enumerate(rows) if i not in (0, 2, 4)]
    dropped = decontamination.drop_contaminated(d, bench, most)
    assert dropped.columns == d.columns and sorted(((r.doc_id, r.text) for r in dropped.collect()), key=key) == sorted(clean, key=key)
    cut = decontamination.cut_contaminated(d, bench, most)
    assert cut.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=key) == sorted([*clean, (None, "x "), (7, "x y"), (8, "a ")], key=key)


# ---- substring deduplication -----------------------------------------------------------------------------------------------------


def test_repeats(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(70)]
    rows = [(i, " ".join([word() for _ in range(40)] + (passage if i % 3 == 0 else []) + [word() for _ in range(40)])) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "one line of few words\n" * 3), (53, rows[1][1]), (53, rows[1][1])]
    out = {}
    for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect():
        out.setdefault(r.doc_id, []).append(r)
    texts = dict(rows)
    for i in range(12):
        (r,) = out[i]
        if i % 3 or i == 0:
            assert not r.removed and r.text == texts[i]
        else:
            (span,) = r.removed
            gone = texts[i][span.start : span.end].split()
            assert " ".join(gone) in " ".join(passage) and len(gone) >= 45 and r.text == texts[i][: span.start] + texts[i][span.end :]
    assert out[50][0].text is None and out[51][0].text == "" and out[52][0].text == "one line of few words\n\n"
    assert [tuple(x) for x in out[52][0].removed] == [(22, 65, 10)]
    assert len(out[53]) == 2 and all(len(r.text) == 0 for r in out[53])
    few = docs_of(spark, [(1, "a b\nc d\n"), (2, "C  d\nnew"), (3, "c d e"), (None, "a b"), (4, "x")]).withColumn("removed", F.lit(1))
    lines = substring_dedup.remove_repeats(few)
    assert {r.doc_id: r.text for r in lines.collect()} == {1: "a b\nc d\n", 2: "\nnew", 3: "c d e", None: "a b", 4: "x"} and lines.columns == few.columns
    assert substring_dedup.remove_repeats(few.limit(0)).count() == 0


def plain_repeats(rows, unit="line", least=25):
    """The words that stay: units repeated anywhere go first, then runs of ``least`` words repeated in what is left between them."""
    seen, kept, first, out = set(), {}, {}, {}
    for doc, text in sorted((i, t or "") for i, t in rows):
        lines = [x.lower().split() for x in text.split("\n")]
        units = [x for x in lines if x]
        if unit == "paragraph":
            units, blank = [], True
            for x in lines:
                if x:
                    units = [*units, x] if blank else [*units[:-1], units[-1] + x]
                blank = not x
        stretches, at, open_ = [], 0, False
        for x in units:
            fresh = tuple(x) not in seen
            seen.add(tuple(x))
            if fresh:
                stretches = [*stretches[:-1], [*stretches[-1], *enumerate(x, at)]] if open_ else [*stretches, list(enumerate(x, at))]
            open_, at = fresh, at + len(x)
        kept[doc] = stretches
    for doc, stretches in kept.items():
        gone = set()
        for words in stretches:
            for i in range(len(words) - least + 1):
                at = words[i][0]
                d, j = first.setdefault(tuple(w for _, w in words[i : i + least]), (doc, at))
                if d < doc or at >= j + least:
                    gone |= set(range(at, at + least))
        out[doc] = [w for words in stretches for at, w in words if at not in gone]
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_repeats_equal_all_windows(spark, unit):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    passages = [words(n) for n in (25, 26, 30, 51, 51, 53, 70)] + [["x"] * 60, ["p", "q"] * 30, words(24), words(9)]
    passages += [passages[3][:28] + words(5), words(9) + passages[6][20:50]]
    line, short = words(12), words(2)
    rows = []
    for i in range(150):
        own = [w.upper() if rng.random() < 0.1 else w for w in rng.choice(passages)]
        text = words(rng.randrange(40)) + own[rng.choice([0, 0, 0, 3]) :] + words(rng.randrange(40))
        broken = "".join(w + ("\n" if rng.random() < 0.03 else " ") for w in text)  # the same passage in other lines
        rows.append((i, rng.choice(["\n", "\n\n", "\n \n"]).join(rng.sample([broken, " ".join(line), " ".join(short), " ".join(words(20))], 4))))
    rows += [(200, "z " * 3000), (201, None), (202, ""), (203, " \n "), (204, rows[0][1])]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_of(spark, rows), unit).collect()}
    want = plain_repeats(rows, unit)
    for i, text in rows:
        assert (got[i].text or "").lower().split() == want[i], i
        assert sum(s.words for s in got[i].removed) == len((text or "").split()) - len(want[i])
        at, rest = 0, ""
        for s in got[i].removed:
            rest, at = rest + text[at : s.start], s.end
        assert got[i].text == (None if text is None else rest + text[at:])


# ---- language --------------------------------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(8)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "de": "en ch ei sch ung ge ver be te ü".split(), "fr": "ou ai eau é è que tre ment oi ç".split()}
    say = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(x, rng.randint(5, 200)), x) for i in range(240) for x in [rng.choice(list(syllables))]]
    odd = [(1000, None, "en"), (1001, "12 -- !", None), (1002, "", "xx"), (1003, say("de", 40_000), None)]
    df = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    model = language_id.fit_language_model(df)
    got = {r.doc_id: r for r in language_id.predict_language(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "de"
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == x for i, x in held]) > 0.95
    assert {r.doc_id for r in language_id.accepted(df).collect()} >= {i for i, _, _ in rows} - {i for i, _, _ in rows if got[i].score < 0.4}
    assert all(r.lang_pred == "und" for r in language_id.predict_language(df, language_id.fit_language_model(df.limit(0))).collect())


def test_language_is_learnt_behind_a_long_header(spark):
    rng = random.Random(9)
    say = lambda x, n: " ".join("".join(rng.choice(x) for _ in range(rng.randint(1, 3))) for _ in range(n))
    syllables, header = {"en": "th er on an re he".split(), "de": "en ch ei sch ung ge".split()}, "LICENCE " * 400
    rows = [(i, header + say(syllables[x], 1500), x) for i in range(80) for x in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(rows + [(90, None, "en"), (91, "", "de")], "doc_id long, text string, lang string")
    cut = {r.doc_id: r.text for r in df.select("doc_id", language_id.stretches(3000).alias("text")).collect()}
    assert cut[90] is None and cut[91] == "" and all(len(cut[i]) <= 3000 and all(x in t for x in cut[i].split("\n")) for i, t, _ in rows)
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(df, language_id.fit_language_model(df)).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) > 0.95


# ---- empty tables, and the tables of the box ---------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert personal_data.find_personal_data(none).count() == personal_data.mask_personal_data(none).count() == 0
    assert piece_codec.encode_documents(none, P.path("piece_bpe_32k.model")).count() == 0
    assert language_id.predict_language(none, language_id.train(["abc def"] * 10, ["x"] * 10)).count() == language_id.accepted(none).count() == 0
    records = spark.createDataFrame([], "conv_id long, turn long, record string")
    turns = chat.canonical_turns(records)
    assert turns.count() == chat.unknown_layouts(records).count() == chat.turn_digests(chat.format_turns(turns)).count() == 0
    talk = spark.createDataFrame([(1, None, None, None), (1, 2, "user", ""), (None, 1, "user", "x"), (1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.turn_digests(chat.format_turns(chat.canonical_turns(chat.conversation_records(talk)))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[None].n_turns == 1


def test_archive_of_pages_with_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a", 5, "x", None), (None, "u", "a", 6, "y", None), (None, None, None, None, None, None)], "page_id long, url string, html string, payload_bytes long, digest string, refers_to long")
    warc.write_archives(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "w"))).collect()
    assert sorted(c.response.record_type for c in captures) == ["response", "response", "revisit"] or sorted(c.response.record_type for c in captures) == ["response"] * 3
    assert sorted(c.response.payload_bytes or 0 for c in captures if c.response.record_type == "response")[0] == 0


DATA = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_tables
def test_secrets_of_the_test_tables(spark):
    """Every planted token is found with exact borders, and hardly anything else is taken for a secret."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: {tuple(x.split(":")) for x in r.spans.split(",") if x} for r in personal_data.find_personal_data(docs).collect()}
    planted = {(i, m.start(), m.end()) for i, t in texts.items() for m in re.finditer(r"(?<![0-9A-Za-z])[0-9a-fA-F]{40}(?![0-9A-Za-z])", t)}
    got = {(i, int(a), int(b)) for i, own in found.items() for k, a, b in own if k == "secret"}
    assert planted and planted <= got and len(got - planted) <= 2


@needs_tables
def test_languages_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op9_query(spark, DATA).where("held_out").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    lettered = [r for r in got if r.lang_pred != "und"]
    assert len(lettered) > 250 and np.mean([r.lang == r.lang_pred for r in lettered]) > 0.97 and all(0 <= r.score <= 1 for r in got)
