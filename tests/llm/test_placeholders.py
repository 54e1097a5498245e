import math
import random

import pytest

from chronoloom.llm import residue
from chronoloom.llm.exemplars import RESIDUE, alternatives, labelled

INDEX = residue.ExemplarIndex(labelled(), 1000, {})

RESIDUE_TEXTS = [
    "This site requires JavaScript to function correctly.", "The requested URL was not found on this server.", "503 Service Temporarily Unavailable", "Oops! That page can’t be found.",
    "You don't have permission to access this resource.", "Your session has timed out. Please log in again.", "We're sorry, but something went wrong.", "Please turn JavaScript on and reload the page.",
    "You need to enable JavaScript to run this app.", "Sorry, the page you are looking for doesn't exist or has been moved.", "Enter your text here", "Website coming soon!", "Under construction",
    "Seite nicht gefunden", "Zugriff verweigert", "Accès refusé", "Une erreur s'est produite. Veuillez réessayer plus tard.", "Acceso denegado", "Página no encontrada", "Сторінку не знайдено", "Доступ заборонено",
    "Sivua ei löytynyt.", "Ota JavaScript käyttöön selaimessasi.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Duis aute irure dolor in reprehenderit in voluptate velit.", "qwerty qwerty qwerty qwerty",
    "The letter went out on Monday. <p>Access denied.</p> All was well.", "Too Many Requests", "A long story about a garden ends here.\n502 Bad Gateway",
    "Hello {{name}}, thank you for your order.", "{{body}}", "{{ " + "a long expression | " * 20 + "}}", "We meet ${place} at noon, bring the \"%(thing)s\".", "Dear [First Name],", "Flights from {0} to {1} today",
]

ORDINARY_TEXTS = [
    "Her album was coming soon, the label said in March.", "Too many requests for tickets reached the theatre last week.", "The path through the forest was closed for maintenance until the spring came.",
    "He wrote a book about JavaScript and how browsers run it.", "Access to the castle is denied to nobody, the guide explained with a smile.", "My session with the doctor has ended and I went home by bus.",
    "They were sorry that something had gone wrong with the delivery of the furniture.", "Please try the soup again later when it is warmer, said the cook.", "An index of the names of all the plants is at the end of the book.",
    "In print tests, designers use lorem ipsum so that readers do not look at the words.", "Not found in nature, the metal must be made in a reactor.", "Scripts must be learned by heart before the actors enter the stage.",
    "The address of the shop does not exist any more since the street was renamed.", "No, no, said the child, and no again.",
    "A template holds `{{ name }}` where the name goes.", "The sign \"{{name}}\" is a placeholder.", "He wrote “${x}” on the board.", "They left [applause] early.", "The method __init__ makes it.", "Take {0} from {1, 2}.", "", None,
]


@pytest.mark.parametrize("text", RESIDUE_TEXTS)
def test_residue(text):
    assert INDEX.residue(text) is not None


@pytest.mark.parametrize("text", ORDINARY_TEXTS)
def test_texts_that_only_speak_of_it(text):
    assert INDEX.residue(text) is None



def test_filler_is_learnt_from_the_corpus(spark):
    """Invented words that stand between words of the common passage, and nowhere else, are filler too."""
    rng = random.Random(4)
    invented, passage = "tromba velun skarit osmal prindo".split(), "lorem ipsum dolor amet velit".split()
    texts = [" ".join(rng.choices(invented * 2 + passage, k=40)) for _ in range(8)] + [f"The house number {i} has a green door and a garden." for i in range(40)]
    texts += ["Tromba skarit velun prindo osmal tromba prindo velun."]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    _, frequencies, filler = residue.document_frequencies(documents, labelled())
    assert filler == frozenset(invented) and all(math.isfinite(n) for n in frequencies.values())
    assert {r["doc_id"] for r in residue.residue_documents(documents).collect()} == set(range(8)) | {48}


def test_kinds_can_be_left_out():
    assert len(labelled(without=("german",))) < len(labelled()) and set(labelled(("german",))) <= set(labelled())
    assert all(residue.exemplar_tokens(p) for p in labelled()) and len(RESIDUE) > 5


def test_alternatives():
    assert sorted(alternatives("(a|b|) c")) == ["a c", "b c", "c"] and alternatives("( x )") == ["( x )"]
    assert set(alternatives("(a|(b|c) d) e")) == {"a e", "b d e", "c d e"}
