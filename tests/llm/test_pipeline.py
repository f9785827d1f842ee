import string

import corpus_pipeline
import tiktoken
from cases import ROWS, SF_DIR, given
from test_decontaminate import brute_force as overlapping
from test_line_dedup import brute_force as without_passages
from test_near_dedup import brute_force as grouped

import __spark_entry__ as contract
from foliospark.llm import line_dedup
from foliospark.llm.byte_bpe import read_ranks
from foliospark.llm.quality import RULES, Measures


def test_pipeline_equals_brute_force(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(line_dedup, "NO_BOUNDARY", 0)

    docs = dict(given("documents", "doc_id, text"))
    docs = {i: t for i, t in docs.items() if not any(r.rejects(Measures(t.encode())) for r in RULES)}
    changed = without_passages(list(docs.items()))
    docs = {i: t for i, (t, n) in changed.items() if not n or t.encode().strip(string.whitespace.encode())}
    docs = {i: docs[i] for i, (_, _, kept) in grouped(list(docs.items()), 5).items() if kept}
    leaked = {i for i, _ in overlapping(list(docs.items()), given("benchmark", "item_id, text"))}
    docs = {i: t for i, t in docs.items() if i not in leaked}
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = contract.queries()["pipeline"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode_ordinary(t) for i, t in docs.items()}


def test_stages_take_awkward_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, a, a, n) for i, t, a, n in ROWS]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF_DIR)
            assert out.columns == frame.columns and out.dtypes == frame.dtypes, name
            out.collect()
        assert len(corpus_pipeline.STAGES[-1][1](spark, frame, SF_DIR).collect()) == frame.count()
