"""The pipeline, and each stage on what the one before it kept, against plain versions."""

import random

import numpy as np
import pytest
from test_near_duplicates import brute
from test_operators import P, plain_contamination

import corpus_pipeline
from tracewright.llm import language_id, personal_data

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, digest string, key int, _row int, _places int, _lang_pred int, score double"


def fixture():
    rng = random.Random(12)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "de": "en ch ei sch ung ge ver be te ü".split()}
    say = lambda x, n: " ".join("".join(rng.choice(syllables[x]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage = say("en", 14)
    docs = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        text = say(lang, rng.randint(20, 120))
        if i % 15 == 3:
            text += f" {passage.upper()} " + say(lang, 5)
        if i % 11 == 2:
            text += f' token = "{"0123456789abcdef" * 2}" mail to a.b{i}@example.org now'
        docs.append((i, text, lang))
    docs += [(200 + i, docs[i][1], docs[i][2]) for i in (0, 1, 3, 7)]  # copies
    words = docs[5][1].split()
    docs += [(210, " ".join([*words[:-1], "changed"]), None), (211, None, "en"), (212, "", "en"), (213, "12 + 34 = 46 !!", None), (214, " \n\t ", "de"), (215, "x", "en"), (216, "é" * 5000, "de"), (217, say("de", 20_000), "de")]
    docs += [docs[4], docs[4], (9, docs[9][1], "en")]  # rows that stand twice
    bench = [(1, passage), (2, None), (3, ""), (1, passage), (4, say("de", 12))]
    return docs, bench


def tables(spark, path, docs, bench):
    rows = [(i, t, x, "s", None if t is None else len(t), "r", "d", 1, 2, 3, 4, 0.5) for i, t, x in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def plain_language(docs, model):
    out = []
    for row in docs:
        words = language_id._WORD.findall((row[1] or "").lower())
        if words:
            buckets, _ = language_id.subwords(words)
            z = (model.table[buckets].mean(0) + model.bias) / model.temperature
            if np.exp(z - z.max()).max() / np.exp(z - z.max()).sum() >= 0.4:
                out.append(row)
    return out


def plain_masked(text, tagger):
    if text is None:
        return None
    spans = [s for _, every in personal_data.all_spans(tagger, [text]) for s in every]
    out, at = "", 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import sentencepiece

    docs, bench = fixture()
    tables(spark, str(tmp_path), docs, bench)
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    now = given
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert name == "tokens" or now.columns == given.columns, name
        path = f"{tmp_path}/out-{name}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = sorted((r.doc_id, r.text) for r in now.collect()) if name != "tokens" else now.collect()
    key = lambda rows: sorted((r[0], r[1]) for r in rows)
    want = plain_language(docs, language_id.fit_language_model(given))
    assert key(want) == kept["language"] and not {211, 212, 213, 214} & {r[0] for r in want}
    one = brute([(i, t) for i, t in {r[0]: r[1] for r in want}.items()])
    want = [r for r in want if one[r[0]][1] == r[0]]
    assert key(want) == kept["near_duplicates"] and not {200, 201, 203, 207, 210} & {r[0] for r in want} and [r[0] for r in want].count(4) == 3
    dirty = {x[0] for x in plain_contamination([r[:2] for r in want], bench) if x[5]}
    want = [r for r in want if r[0] not in dirty]
    assert dirty and key(want) == kept["benchmark"]
    tagger = personal_data.Tagger(personal_data.default_field())
    want = [(r[0], plain_masked(r[1], tagger)) for r in want]
    assert key(want) == kept["personal"] and any("[email]" in t and "[secret]" in t for _, t in want)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = [(i, library.encode(t, add_bos=True, add_eos=True)) for i, t in want]
    told = sorted((i, x, library.decode(x), len(x)) for i, x in ids)
    assert sorted((r.doc_id, r.ids, r.decoded, r.n_tokens) for r in kept["tokens"]) == told
    assert sorted((r.doc_id, r.ids, r.decoded, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == told
    assert {r.n_chars for r in spark.read.parquet(f"{tmp_path}/out-personal").collect()} == {len(t) for _, t in want}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (1, None, None), (2, "", "en"), (3, " ", None)]])
def test_pipeline_of_next_to_nothing(spark, tmp_path, rows):
    tables(spark, str(tmp_path), rows, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, given, str(tmp_path))
        assert out.count() == len(rows), name
