"""Residue: unseen wordings, and that recurrence decides."""
from fadegraph.llm import residue

#: Common public wordings, gathered before the rules were written and not used to write them; 35 of 42 were found at first.
UNSEEN = [
    "Enable JS and disable any ad blocker", "502 Proxy Error\nThe proxy server received an invalid response from an upstream server.", "Under construction", "Insert text here",
    "Dear [Customer Name], thanks for [product]", "Page non disponible pour le moment",
    "Hello {{customer.first_name}}, your order ${order.number} has shipped.", "Hi %FIRSTNAME%, welcome aboard!", "Sehr geehrte/r [Kundenname], vielen Dank für Ihre Bestellung.",
    "Estimado {nombre_cliente}: su pedido está listo.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.",
    "This site requires JavaScript. Please enable JavaScript in your browser settings and reload the page.", "Your browser does not support JavaScript!",
    "You need to enable JavaScript to run this app.", "Just a moment... Enable JavaScript and cookies to continue", "Checking your browser before accessing the site. Please wait.",
    "404 - File or directory not found. The resource you are looking for might have been removed.", "HTTP Error 503. The service is unavailable.", "500 Internal Server Error nginx",
    "Sorry, the page you requested could not be found.", "Oops! That page can’t be found.", "403 Forbidden\nYou don't have permission to access this resource.", "Service temporarily unavailable. Please try again later.",
    "An unexpected error has occurred. Please try again.", "Your session has timed out. Please log in again.", "This website is temporarily down for maintenance.", "Error establishing a database connection",
    "La page que vous recherchez est introuvable.", "Une erreur inattendue s'est produite. Veuillez réessayer plus tard.", "Die Seite wurde nicht gefunden.", "Diese Website benötigt JavaScript. Bitte aktivieren Sie JavaScript.",
    "Ein unerwarteter Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.", "Lo sentimos, la página que busca no existe.", "Se ha producido un error inesperado. Inténtelo de nuevo más tarde.",
    "Active las cookies y JavaScript en su navegador para continuar.", "Content coming soon.", "TODO: write this section", "Sample text. Sample text. Sample text.", "Hier entsteht eine neue Internetpräsenz. Inhalt folgt in Kürze.",
    "Texte à compléter", "Esta página está en construcción.", "qwerty asdf asdf asdf",
]
REAL = [
    "When the gateway times out, our retry loop waits two seconds, doubles the delay and writes the failed request into the dead letter queue, which Anna drains by hand each morning.",
    "The phrase 'lorem ipsum' goes back to a passage of Cicero; printers have used it since the sixteenth century to judge typefaces without being distracted by meaning.",
    "We removed the script that asked readers to enable JavaScript, because the server now renders every graph itself and the client only adds tooltips.",
    "Session notes: three reviewers compared the calibration of both benches and found the second one drifting by two nanometres over the afternoon.",
    "Der Fehler trat nur auf, wenn zwei Schreiber denselben Schlüssel innerhalb einer Sekunde änderten; seit dem Umbau der Warteschlange ist er nicht mehr gesehen worden.",
    "La page de garde du manuscrit porte une date effacée que le laboratoire a pu lire sous lumière rasante en mars.",
    "El servidor nuevo tarda la mitad en responder porque los índices caben en memoria y las consultas ya no leen el disco.",
    "Use `{{name}}` in the template and the mail builder fills in the recipient before the message is sent.",
]
SCHEMA = "doc_id bigint, text string, source string"


def found(spark, rows):
    return {r.doc_id for r in residue.residue(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_unseen_wordings(spark):
    rows = [(1000 + i, t, "a") for i, t in enumerate(UNSEEN)] + [(i, t, "b") for i, t in enumerate(REAL)]
    got = found(spark, rows)
    assert len([x for x in got if x >= 1000]) >= 0.8 * len(UNSEEN)
    assert not [x for x in got if x < 1000]


def test_recurrence_decides(spark):
    # one weak sign only: boilerplate if it stands bare in three texts of two sources, else a sentence like any other
    weak = "Bitte Zugriff künftig gedulden Redaktion arbeitet derzeit daran, lumen pico."
    bare = [(i, f"{h}\n{weak}", s) for i, (h, s) in enumerate([("Alpha", "a"), ("Beta", "b"), ("Gamma", "a"), ("Delta", "c")])]
    assert found(spark, bare) == {0, 1, 2, 3}
    assert found(spark, bare[:1]) == set()  # seen once
    assert found(spark, [(i, t, "a") for i, t, _ in bare]) == set()  # one source
    assert found(spark, [(i, bare[0][1], s) for i, _, s in bare]) == set()  # copies of one text
    real = [(10 + i, f"{weak} Sample {'kiln ' * 9}{i} was measured twice by both {'teams ' * i}.", s) for i, (_, _, s) in enumerate(bare * 3)]
    assert found(spark, real) == set()  # among words that do not recur


def test_sources_may_be_null_and_columns_may_clash(spark):
    df = spark.createDataFrame([(None, "TBD.", None, 1, "x"), (2, None, None, 1, "x"), (3, "", "s", 1, "x"), (4, "x" * 300_000, "s", 1, "x")], SCHEMA + ", h int, segs string")
    assert [r.doc_id for r in residue.residue(df).collect()] == [None]
