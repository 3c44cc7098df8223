import pytest

from tidings.functions.stems import stem_table

# Words and their stems, most of them from the published vocabularies of the rules.
PAIRS = {
    "en": "consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol knackeries knackeri knaves knave knavish knavish knee knee kneeling kneel knew knew knightly knight caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop hoping hope falling fall hissing hiss filing file happy happi cry cri say say relational relat conditional condit rational ration formality formal sensibility sensibl hopefulness hope electrical electr replacement replac adjustment adjust adoption adopt generate generat generous generous community communiti dying die news news gas gas this this controlling control rate rate",
    "de": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg kategorie kategori kategorien kategori kater kat katers kat häuser haus hauses haus kindlich kindlich schönheit schonheit freundlichkeit freundlich verbindung verbind verbindungen verbind zeitungen zeitung ergebnisse ergebnis abenteuerlich abenteu laufen lauf läuft lauft",
    "nl": "lichaamsziek lichaamsziek lichamelijk licham lichamelijke licham lichamelijkheden licham lichamen licham lichtbron lichtbron lichtende lichtend mogelijkheden mogelijk mogelijkheid mogelijk opgingen opging opheffing opheff katten kat boeken boek grote grot",
    "sv": "jaktkarlarne jaktkarl jaktkarlens jaktkarl jaktlust jaktlust jakt jakt kloekornas kloek klostergården klostergård möjlighet möj friheten frihet hundarna hund",
    "no": "havnedistriktene havnedistrikt havnedistriktet havnedistrikt havneeffektivitet havneeffektivit havnemyndighetene havnemynd opning opning opninga opning opningsbalanse opningsbalans husene hus",
    "da": "indtage indtag indtagelse indtag indtager indtag indtages indtag indtaget indtag indtil indtil underste underst undersåtter undersåt undersøgelse undersøg huset hus venlighed ven",
    "es": "chicana chican chicano chican chicas chic chicharrones chicharron chico chic toreado tor toreándolo tor toreo tore torear tor torero torer corriendo corr nación nacion naciones nacion rápidamente rapid comunidad comun universidades univers hablaban habl tecnología tecnolog casas cas",
    "pt": "boa boa boainain boainain boas boas bobagem bobag bobagens bobagens bocais boc bochechas bochech boiando boi quilométricas quilométr quilômetros quilômetr quis quis quiser quis nacionalidade nacional rapidamente rapid casas cas",
    "it": "abbandonata abbandon abbandonate abbandon abbandonerà abbandon abbandonò abbandon abbaruffato abbaruff pronto pront pronuncerà pronunc pronunciamento pronunc propaganda propagand nazione nazion nazioni nazion libertà libert parlando parl velocemente veloc",
    "fr": "continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel continuelle continuel continuellement continuel majestueusement majestu majestueux majestu majeur majeur majorité major maison maison maisons maison chevaux cheval nationalité national rapidement rapid finissons fin mangeaient mang",
    "ru": "в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон важная важн важнее важн важнейшие важн важничал важнича падаль падал падать пада падеж падеж пальто пальт красивая красив новости новост",
}


@pytest.fixture(scope="module")
def stems(spark):
    rows = [(lang, w) for lang, pairs in PAIRS.items() for w in pairs.split()[::2]]
    rows += [("en", None), (None, "running"), ("xx", "running"), ("en", "o’clock"), ("en", ""), ("en", "running"), ("en", "running")]
    return {(r.language, r.word): r.stem for r in stem_table(spark.createDataFrame(rows, "language string, word string")).collect()}


@pytest.mark.parametrize("lang", sorted(PAIRS))
def test_published_pairs(stems, lang):
    pairs = PAIRS[lang].split()
    wrong = [(w, s, stems[lang, w]) for w, s in zip(pairs[::2], pairs[1::2]) if stems[lang, w] != s]
    assert not wrong


def test_other_words(stems):
    assert stems["", "running"] == stems["xx", "running"] == "running"
    assert stems["en", "running"] == "run" and stems["en", ""] == ""
    assert ("en", None) not in stems
