"""Every run of letters of a word counts in the toxicity model."""

from auditloom.llm import op03_toxicity as toxicity


def test_all_runs_of_letters():
    assert toxicity.features("l'idiot") == ("l", "idiot", "idio*", "idiot*")
    assert toxicity.features("and/idiot,and") == ("and", "idiot", "idio*", "idiot*")
    assert toxicity.features("plain") == ("plain", "plai*", "plain*") and toxicity.features("42") == ()


def test_a_word_behind_a_slash_is_scored():
    w = toxicity.Weights(toxicity.Model({"idiot": 3.0}, 0.0))
    assert w["and/idiot"] == w["l'idiot"] == 3.0
