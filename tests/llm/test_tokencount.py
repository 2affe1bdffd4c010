import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesync.llm import tokencount

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdeéß1234<>/s▁日龘"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_as_the_library(text):
    assert tokencount.counter(PATH).count(text) == len(LIBRARY.encode(text))


def test_rows(spark):
    texts = [None, "", " ", "hello  world", "<s>x</s> <0x0A>", "word " * 3000, "z" * 4000, "   lead", "龘" * 50]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in tokencount.token_counts(docs, PATH).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(LIBRARY.encode(text)))
    assert tokencount.token_counts(docs.limit(0), PATH).count() == 0
