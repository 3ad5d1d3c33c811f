import pytest

#: Odd texts that every operator must take: null, empty, blank, repeated, non-ASCII, clashing rows.
ODD = [None, "", "   \n\t ", "one", "a b c", "Ünï çödé straße 日本 語", "x\n\nx\nx", "dup line here now\ndup line here now\n", "the the the the the",
       "a $$$ b ### c %%% <|endoftext|> d", "tail\n", "\x0bw\x0cw\x1fw\xa0w"]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD


@pytest.fixture()
def documents(spark):
    """A maker of documents tables from texts, with every column of the real table."""

    def make(texts, first=0, **extra):
        rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
