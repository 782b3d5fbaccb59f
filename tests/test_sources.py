import pytest

from lodestone.operators import reports
from lodestone.sources import corpus as src

DOCS = """<DOC>
<DOCNO> FX-0001 </DOCNO>
<HEADER>
<H3> <TI>   River Trade Report </TI></H3>
<F P=104> Lisbon PORTUGAL </F>
</HEADER>
<TEXT>
<F P=105> English </F>
<F P=106> [Article by Ashley Cummins] </F>
Ashley Cummins Brittingham, said prices rose to $450,000
<P>on 16 June.</P>
</TEXT>
</DOC>

<DOC>
<DOCNO> FX-0002 </DOCNO>
<HEADLINE>
<P>
Second headline line
ignored second line
</P>
</HEADLINE>
<TEXT>
Body without city or language.
</TEXT>
</DOC>"""

TOPICS = """<top>
<num> Number: 901
<title> river trade prices

<desc> Description:
Find documents that discuss river trade and the price of
shipping grain.

<narr> Narrative:
Ignored by retrieval.

</top>

"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "corpus" / "sub").mkdir(parents=True)
    (tmp_path / "corpus" / "sub" / "fx.txt").write_text(DOCS)
    (tmp_path / "corpus" / "stop_words.txt").write_text("the\nof\n")
    (tmp_path / "topics.txt").write_text(TOPICS)
    (tmp_path / "qrels.txt").write_text("901 0 FX-0001 1\n901 0 FX-0002 0\n")
    return tmp_path


def test_sgml(spark, folder):
    rows = {r["doc_id"]: r for r in src.read_sgml(spark, str(folder / "corpus")).collect()}
    assert set(rows) == {"FX-0001", "FX-0002"}
    one, two = rows["FX-0001"], rows["FX-0002"]
    assert (one["city"], one["lang"], one["parent_file"]) == ("LISBON", "ENGLISH", "fx.txt")
    assert one["headline"].split() == ["River", "Trade", "Report"]
    assert "on 16 June." in one["text"] and "Ashley Cummins" in one["text"]
    assert (two["city"], two["lang"], two["headline"]) == (None, None, "Second headline line")
    assert two["text"] == "Body without city or language."


def test_block_without_number():
    assert src.parse_document("<TEXT>\nx\n</TEXT>") is None


def test_stop_words(spark, folder):
    assert src.read_stop_words(spark, str(folder / "corpus/stop_words.txt")) == {"the", "of"}
    with pytest.raises(Exception):  # noqa: B017
        src.read_stop_words(spark, str(folder / "none.txt"))


def test_topics(spark, folder):
    (row,) = src.read_topics(spark, str(folder / "topics.txt")).collect()
    assert row["query_id"] == "901" and row["title"] == "river trade prices"
    assert row["description"] == "Find documents that discuss river trade and the price of shipping grain."
    assert row["narrative"] == "Ignored by retrieval."


def test_qrels(spark, folder):
    stats = spark.createDataFrame([("FX-0001", "fx.txt")], "doc_id string, parent_file string")
    rows = reports.judged_files(src.read_qrels(spark, str(folder / "qrels.txt")), stats).collect()
    assert [tuple(r) for r in rows] == [(901, "FX-0001", "fx.txt")]


def test_related_words(spark):
    raw = spark.createDataFrame([("ship", '[{"word":"boat","score":1},{"word":"vessel"}]')], "term string, json string")
    assert [tuple(r) for r in src.related_words(spark, raw).orderBy("rank").collect()] == [("ship", "boat", 1), ("ship", "vessel", 2)]


def test_city_info(spark):
    cities = spark.createDataFrame([("LISBON",), ("PANAMA",), ("NOWHERE",)], "city string")
    countries = spark.createDataFrame([("Portugal", "Lisbon", 10300000, "EUR"), ("Panama", "Panama City", 950000, "PAB")], "name string, capital string, population long, currency_code string")
    rows = {r["city"]: (r["country"], r["currency"], r["population"]) for r in src.city_info(cities, countries).collect()}
    assert rows == {"LISBON": ("Portugal", "EUR", "M10.3"), "PANAMA": ("Panama", "PAB", "950000"), "NOWHERE": (None, None, None)}
    summary = reports.city_summary(src.city_info(cities, countries)).first()
    assert tuple(summary) == (3, 1)
