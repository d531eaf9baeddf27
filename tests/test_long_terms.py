from vellumite.operators import terms


def test_long_terms_and_terms_with_signs(spark):
    glossary = spark.createDataFrame(
        [(1, "a", "The Calling of the Goat"), (2, "b", "Keeper's Guide"), (3, "c", "Hand-to-Hand"), (4, "d", "Health (HP)"), (5, "e", "Goat"), (6, "f", "[Secret]"), (7, "g", "Delta Green")],
        "ord int, target string, term string",
    )
    texts = spark.createDataFrame(
        [(1, "He hears the calling  of\nthe goat."), (2, "The keeper's guide"), (3, "Hand-to-hand, hand to hand"), (4, "Health (HP) and health HP"), (5, "x[secret] secret [Secret]"), (6, "delta-green Delta Green"), (7, None)],
        "id int, text string",
    )
    found = {(r.id, r.start, r.n_words, r.term) for r in terms.matches(texts, glossary).collect()}
    assert found == {
        (1, 2, 5, "The Calling of the Goat"), (1, 6, 1, "Goat"), (2, 1, 3, "Keeper's Guide"), (3, 0, 3, "Hand-to-Hand"),
        (4, 0, 2, "Health (HP)"), (5, 3, 1, "[Secret]"), (6, 2, 2, "Delta Green"),
    }
    assert {r.term for r in terms.selected(terms.matches(texts, glossary)).where("id = 1").collect()} == {"The Calling of the Goat"}
