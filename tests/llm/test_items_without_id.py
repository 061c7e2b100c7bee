from lexiquarry.llm.decontam import clean, contaminated


def test_items_without_id_are_found(spark):
    first, second = "Which river runs past the old town hall? The amber Velden", "How many lanterns hang above the gate? Forty seven bronze ones"
    docs = spark.createDataFrame([(1, "before it " + first + " after it"), (2, second), (3, "nothing of the kind here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, first), (None, "Who painted the ceiling of the chapel? Nobody knows"), (5, second), (None, first)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(1, None), (2, 5)]
    assert [r.doc_id for r in clean(docs, items).collect()] == [3]
