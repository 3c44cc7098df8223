import re

import pytest

from tidings.functions.boolean import QueryError, any_term, predicate, tsquery, upper_booleans

PAIRS = [
    ("harvest", "harvest"),
    ("wheat rye", "( wheat | rye )"),
    ("wheat AND rye and barley", "( wheat & rye & barley )"),
    ("drought and ( flood or ( storm frost ) )", "( drought & ( flood | storm | frost ) )"),
    ("rain or hail and snow", "( ( rain | hail ) & snow )"),
    ("price -tariff", "( price & !tariff )"),
    ("price and not ( tariff quota )", "( price & !( tariff | quota ) )"),
    ("+price tariff +quota", "( ( price | tariff ) & quota )"),
    ('"soil moisture" drought', "( ( soil & moisture ) | drought )"),
    ('"north-south trade"', "( north & south & trade )"),
    ("irrigat* or well*", "( irrigat:* | well:* )"),
    ("language:de and ernte", "ernte"),
    ("ernte and publish_day:[2020 TO 2021] and media_id:( 4 or 5 )", "ernte"),
    ("text:( dam or weir ) and title:river", "( dam | weir )"),
    ("“урожай” and пшеница", "( урожай & пшеница )"),
]


def tidy(text):
    return re.sub(r"\s+", " ", re.sub(r"([()])", r" \1 ", text)).strip()


@pytest.mark.parametrize("query, want", PAIRS)
def test_trees(query, want):
    assert tidy(tsquery(query)) == tidy(want)


@pytest.mark.parametrize("query", ["or", "*rye", "language:de", "( rye", "rye )", "rye/oats", "", "rye and"])
def test_errors(query):
    with pytest.raises(QueryError):
        tsquery(query)


def test_predicates(spark):
    rows = [(1, "Rye breads"), (2, "bread rye"), (3, "xrye"), (4, "Осень сегодня"), (5, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    ids = lambda q: [r.id for r in df.filter(predicate(q)).orderBy("id").collect()]
    assert ids("rye and bread") == [1, 2] and ids('"rye bread"') == [1] and ids('"bread rye"~3') == [1, 2]
    assert ids("осень") == [4] and ids("сень") == [] and ids("rye -breads") == [2]
    assert [r.id for r in df.filter(any_term("rye and сегодня")).orderBy("id").collect()] == [1, 2, 4]
    assert upper_booleans('a and "b or c" not d') == 'a AND "b or c" NOT d'
