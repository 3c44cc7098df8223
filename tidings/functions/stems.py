"""Stems of words by suffix rules with measured regions, as steps over a table of distinct words.

A language's rules are data: steps of groups of endings. Of a step's endings the longest that a word has
decides; its group says in which region it must lie, what must stand before it, and what is put in its
place. Regions are measured once, on the whole word. ``stem_table`` runs the steps of each language over its
own words, by column expressions only; so a word is stemmed once, however often texts hold it. ``stemmer``
runs the same rules on a word inside a task, where a join of all words with their stems would be the dearest step.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ends(NamedTuple):
    """Endings that are treated alike."""

    endings: str
    region: str = ""  #: r1, r2 or rv: where the ending must begin; empty: anywhere
    put: str = ""
    before: str = ""  #: regex that what is before the ending must end with
    mark: str = "done"  #: left on words that the group has changed


class Step(NamedTuple):
    groups: tuple[Ends, ...]
    within: str = ""  #: only endings inside this region are looked for (else the longest decides, wherever it lies)
    only: tuple[str, ...] = ()  #: only for words with one of these marks ("" : unmarked); others keep theirs
    fresh: bool = False  #: marks of steps before are taken off first


class Swap(NamedTuple):
    """A plain replacement by regex."""

    pattern: str
    put: str
    only: tuple[str, ...] = ()


class Rules(NamedTuple):
    vowels: str
    steps: tuple
    first: tuple[Swap, ...] = ()  #: before regions are measured
    least: int = 0  #: r1 begins after so many letters at the earliest
    rv: str = ""  #: regex of what stands before rv
    short: int = 3  #: words of fewer letters stay


def ends(endings: str, region: str = "", put: str = "", before: str = "", mark: str = "done") -> Ends:
    return Ends(endings, region, put, before, mark)


def step(*groups: Ends, within: str = "", only: tuple = (), fresh: bool = False) -> Step:
    return Step(groups, within, only, fresh)


# The published suffix rules of each language, in the order in which they apply.
_ROMANCE_RV = "^(?:.[^{v}].*?[{v}]|[{v}]{{2}}.*?[^{v}]|[^{v}][{v}].)"
_ES, _PT, _IT, _FR = "aeiouáéíóúü", "aeiouáéíóúâêô", "aeiouàèìòù", "aeiouyâàëéêèïîôûù"
_NORDIC = "aeiouyæøåäö"

RULES: dict[str, Rules] = {
    "en": Rules(
        "aeiouy",
        first=(Swap("^'", ""), Swap("^y", "Y"), Swap("(?<=[aeiouy])y", "Y")),
        steps=(
            step(ends("'s' 's '")),
            step(ends("sses", put="ss"), ends("ied ies", put="i", before=".."), ends("ied ies", put="ie", before="^."), ends("us ss", put=None), ends("s", before="[aeiouy].+"), fresh=True),
            step(ends("eed eedly", "r1", "ee", mark="eed"), ends("ed edly ing ingly", before="[aeiouy].*", mark="cut"), fresh=True),
            step(ends("at", put="ate", mark="e"), ends("bl", put="ble", mark="e"), ends("iz", put="ize", mark="e"), *(ends(c + c, put=c, mark="e") for c in "bdfgmnprt"), only=("cut",)),
            Swap("^((?:[^aeiouy]*[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy]))$", "$1e", only=("cut",)),
            Swap("(?<=.[^aeiouy])[yY]$", "i"),
            step(
                ends("tional", "r1", "tion"), ends("enci", "r1", "ence"), ends("anci", "r1", "ance"), ends("abli", "r1", "able"), ends("entli", "r1", "ent"),
                ends("izer ization", "r1", "ize"), ends("ational ation ator", "r1", "ate"), ends("alism aliti alli", "r1", "al"), ends("fulness", "r1", "ful"), ends("ousli ousness", "r1", "ous"),
                ends("iveness iviti", "r1", "ive"), ends("biliti bli", "r1", "ble"), ends("ogi", "r1", "og", "l"), ends("fulli", "r1", "ful"), ends("lessli", "r1", "less"), ends("li", "r1", "", "[cdeghkmnrt]"),
                fresh=True,
            ),
            step(
                ends("tional", "r1", "tion"), ends("ational", "r1", "ate"), ends("alize", "r1", "al"), ends("icate iciti ical", "r1", "ic"), ends("ful ness", "r1"), ends("ative", "r2"),
                fresh=True,
            ),
            step(ends("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "r2"), ends("ion", "r2", "", "[st]"), fresh=True),
            step(ends("e", "r2"), ends("l", "r2", "", "l"), fresh=True),
            step(ends("e", "r1", "", "(?:^|[aeiouy].*|[^aeiouy]{2}|[aeiouy][wxY])(?<!^[aeiouy][^aeiouy])(?<![^aeiouy][aeiouy][^aeiouywxY])"), only=("",)),
            Swap("Y", "y"),
        ),
    ),
    "de": Rules(
        "aeiouyäöü",
        first=(Swap("ß", "ss"), Swap("(?<=[aeiouyäöü])u(?=[aeiouyäöü])", "U"), Swap("(?<=[aeiouyäöü])y(?=[aeiouyäöü])", "Y")),
        least=3,
        steps=(
            step(ends("em ern er", "r1"), ends("e en es", "r1", mark="niss"), ends("s", "r1", "", "[bdfghklmnrt]"), fresh=True),
            step(ends("s", before="nis"), only=("niss",)),
            step(ends("en er est", "r1"), ends("st", "r1", "", "...[bdfghklmnt]"), fresh=True),
            step(ends("end ung", "r2", mark="ig"), ends("ig ik isch", "r2", "", "(?<!e)"), ends("lich heit", "r2", mark="er"), ends("keit", "r2", mark="lich"), fresh=True),
            step(ends("ig", "r2", "", "(?<!e)"), only=("ig",)),
            step(ends("er en", "r1"), only=("er",)),
            step(ends("lich ig", "r2"), only=("lich",)),
            Swap("U", "u"), Swap("Y", "y"), Swap("ä", "a"), Swap("ö", "o"), Swap("ü", "u"),
        ),
    ),
    "nl": Rules(
        "aeiouyè",
        first=(Swap("[äá]", "a"), Swap("[ëé]", "e"), Swap("[ïí]", "i"), Swap("[öó]", "o"), Swap("[üú]", "u"), Swap("^y", "Y"), Swap("(?<=[aeiouyè])y", "Y"), Swap("(?<=[aeiouyè])i(?=[aeiouyè])", "I")),
        least=3,
        steps=(
            step(ends("heden", "r1", "heid", mark="x"), ends("en ene", "r1", "", "(?<!gem)(?<=[^aeiouyè])", "twin"), ends("s se", "r1", "", "[^aeiouyèj]", "x"), fresh=True),
            Swap("(k|d|t)\\1$", "$1", only=("twin",)),
            step(ends("e", "r1", "", "[^aeiouyè]", "e"), fresh=True),
            Swap("(k|d|t)\\1$", "$1", only=("e",)),
            step(ends("heid", "r2", "", "(?<!c)", "heid"), only=("", "e")),
            step(ends("en", "r1", "", "(?<!gem)(?<=[^aeiouyè])", "twin"), only=("heid",)),
            Swap("(k|d|t)\\1$", "$1", only=("twin",)),
            step(ends("end ing", "r2", mark="ig"), ends("ig", "r2", "", "(?<!e)", "x"), ends("lijk", "r2", mark="lijk"), ends("baar", "r2", mark="x")),
            step(ends("bar", "r2"), only=("e",)),
            step(ends("ig", "r2", "", "(?<!e)", "x"), only=("ig",)),
            step(ends("e", "r1", "", "[^aeiouyè]", "twin"), only=("lijk",)),
            Swap("(k|d|t)\\1$", "$1", only=("ig", "twin")),
            Swap("(?<=[^aeiouyè])(a|e|o|u)\\1([^aeiouyèI])$", "$1$2"), Swap("I", "i"), Swap("Y", "y"),
        ),
    ),
    "sv": Rules(
        "aeiouyäåö",
        least=3,
        steps=(
            step(ends("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"), ends("s", before="[bcdfghjklmnoprtvy]"), within="r1"),
            step(*(ends(x, put=x[0]) for x in ("dd", "gd", "nn", "dt", "gt", "kt", "tt")), within="r1"),
            step(ends("lig ig els"), ends("löst", put="lös"), ends("fullt", put="full"), within="r1"),
        ),
    ),
    "no": Rules(
        "aeiouyæåø",
        least=3,
        steps=(
            step(ends("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"), ends("s", before="[bcdfghjlmnoprtvyz]|[^aeiouyæåø]k"), ends("erte ert", put="er"), within="r1"),
            step(ends("dt", put="d"), ends("vt", put="v"), within="r1"),
            step(ends("leg eleg ig eig lig elig els lov elov slov hetslov"), within="r1"),
        ),
    ),
    "da": Rules(
        "aeiouyæåø",
        least=3,
        steps=(
            step(ends("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"), ends("s", before="[abcdfghjklmnoprtvyzå]"), within="r1"),
            step(*(ends(x, put=x[0]) for x in ("gd", "dt", "gt", "kt")), within="r1"),
            Swap("igst$", "ig"),
            step(ends("ig lig elig els", mark="again"), ends("løst", put="løs"), within="r1", fresh=True),
            step(*(ends(x, put=x[0]) for x in ("gd", "dt", "gt", "kt")), within="r1", only=("again",)),
            step(*(ends(c + c, put=c) for c in "bcdfghjklmnpqrstvwxz"), within="r1"),
        ),
    ),
    "es": Rules(
        _ES,
        rv=_ROMANCE_RV.format(v=_ES),
        steps=(
            step(ends("me se sela selo selas selos la le lo las les los nos", "rv", "", "(?:iéndo|ándo|[áéí]r|ando|iendo|[aei]r|uyendo)", "pronoun"), fresh=True),
            *(Swap(a, b, only=("pronoun",)) for a, b in (("iéndo$", "iendo"), ("ándo$", "ando"), ("ár$", "ar"), ("ér$", "er"), ("ír$", "ir"))),
            step(
                ends("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "r2"),
                ends("adora ador ación adoras adores aciones ante antes ancia ancias", "r2", mark="ic"),
                ends("logía logías", "r2", "log"), ends("ución uciones", "r2", "u"), ends("encia encias", "r2", "ente"),
                ends("amente", "r1", mark="amente"), ends("mente", "r2", mark="mente"), ends("idad idades", "r2", mark="idad"), ends("iva ivo ivas ivos", "r2", mark="at"),
                fresh=True,
            ),
            step(ends("ic", "r2"), only=("ic",)), step(ends("iv", "r2", mark="at"), ends("os ic ad", "r2"), only=("amente",)), step(ends("ante able ible", "r2"), only=("mente",)),
            step(ends("abil ic iv", "r2"), only=("idad",)), step(ends("at", "r2"), only=("at",)),
            step(ends("ya ye yan yen yeron yendo yo yó yas yes yais yamos", before="u", mark="verb"), within="rv", only=("",)),
            step(
                ends("en es éis emos", mark="gu"),
                ends("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos", mark="verb"),
                within="rv", only=("",),
            ),
            Swap("(?<=g)u$", "", only=("gu",)),
            step(ends("os a o á í ó", "rv"), ends("e é", "rv", mark="gue"), fresh=True),
            step(ends("u", "rv", "", "g"), only=("gue",)),
            Swap("á", "a"), Swap("é", "e"), Swap("í", "i"), Swap("ó", "o"), Swap("ú", "u"),
        ),
    ),
    "pt": Rules(
        _PT,
        first=(Swap("ã", "a~"), Swap("õ", "o~")),
        rv=_ROMANCE_RV.format(v=_PT),
        steps=(
            step(
                ends("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", "r2"),
                ends("logia logias", "r2", "log"), ends("uça~o uço~es", "r2", "u"), ends("ência ências", "r2", "ente"),
                ends("amente", "r1", mark="amente"), ends("mente", "r2", mark="mente"), ends("idade idades", "r2", mark="idade"), ends("iva ivo ivas ivos", "r2", mark="at"), ends("ira iras", "rv", "ir", "e"),
                fresh=True,
            ),
            step(ends("iv", "r2", mark="at"), ends("os ic ad", "r2"), only=("amente",)), step(ends("ante avel ível", "r2"), only=("mente",)),
            step(ends("abil ic iv", "r2"), only=("idade",)), step(ends("at", "r2"), only=("at",)),
            step(
                ends("ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras", mark="verb"),
                within="rv", only=("",),
            ),
            step(ends("i", "rv", "", "c", "end"), only=("done", "verb", "amente", "mente", "idade", "at")),
            step(ends("os a i o á í ó", "rv", mark="end"), only=("",)),
            step(ends("e é ê", "rv", mark="gue"), ends("ç", put="c")),
            step(ends("u", "rv", "", "g"), ends("i", "rv", "", "c"), only=("gue",)),
            Swap("a~", "ã"), Swap("o~", "õ"),
        ),
    ),
    "it": Rules(
        _IT,
        first=(Swap("á", "à"), Swap("é", "è"), Swap("í", "ì"), Swap("ó", "ò"), Swap("ú", "ù"), Swap("qu", "qU"), Swap("(?<=[aeiouàèìòù])u(?=[aeiouàèìòù])", "U"), Swap("(?<=[aeiouàèìòù])i(?=[aeiouàèìòù])", "I")),
        rv=_ROMANCE_RV.format(v=_IT),
        steps=(
            step(
                ends("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene", "rv", "", "(?:[ae]ndo)"),
                ends("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene", "rv", "e", "(?:[aei]r)"),
            ),
            step(
                ends("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", "r2"),
                ends("azione azioni atore atori", "r2", mark="ic"), ends("logia logie", "r2", "log"), ends("uzione uzioni usione usioni", "r2", "u"), ends("enza enze", "r2", "ente"),
                ends("amento amenti imento imenti", "rv"), ends("amente", "r1", mark="amente"), ends("ità", "r2", mark="ità"), ends("ivo ivi iva ive", "r2", mark="at"),
                fresh=True,
            ),
            step(ends("ic", "r2"), only=("ic",)), step(ends("iv", "r2", mark="at"), ends("os ic abil", "r2"), only=("amente",)), step(ends("abil ic iv", "r2"), only=("ità",)),
            step(ends("at", "r2", mark="atic"), only=("at",)), step(ends("ic", "r2"), only=("atic",)),
            step(
                ends("ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"),
                within="rv", only=("",),
            ),
            step(ends("a e i o à è ì ò", "rv", mark="vowel"), fresh=True),
            step(ends("i", "rv"), only=("vowel",)),
            step(ends("ch", "rv", "c"), ends("gh", "rv", "g")),
            Swap("U", "u"), Swap("I", "i"),
        ),
    ),
    "fr": Rules(
        _FR,
        first=(Swap("(?<=q)u", "U"), Swap("(?<=[aeiouyâàëéêèïîôûù])u(?=[aeiouyâàëéêèïîôûù])", "U"), Swap("(?<=[aeiouyâàëéêèïîôûù])i(?=[aeiouyâàëéêèïîôûù])", "I"), Swap("(?<=[aeiouyâàëéêèïîôûù])y|y(?=[aeiouyâàëéêèïîôûù])", "Y")),
        rv="^(?:par|col|tap|[aeiouyâàëéêèïîôûù]{2}.|.[^aeiouyâàëéêèïîôûù]*?[aeiouyâàëéêèïîôûù])",
        steps=(
            step(
                ends("ance iqUe isme able iste eux ances iqUes ismes ables istes", "r2"), ends("atrice ateur ation atrices ateurs ations", "r2", mark="ic"), ends("logie logies", "r2", "log"), ends("usion ution usions utions", "r2", "u"), ends("ence ences", "r2", "ent"),
                ends("ement ements", "rv", mark="ement"), ends("ité ités", "r2", mark="ité"), ends("if ive ifs ives", "r2", mark="at"), ends("eaux", put="eau"), ends("aux", "r1", "al"),
                ends("euse euses", "r2"), ends("euse euses", "r1", "eux"), ends("issement issements", "r1", "", "[^aeiouyâàëéêèïîôûù]"),
                ends("amment", "rv", "ant", mark="adverb"), ends("emment", "rv", "ent", mark="adverb"), ends("ment ments", "", "", "(?<=.)[aeiouyâàëéêèïîôûù]", "adverb"),
                fresh=True,
            ),
            step(ends("ic", "r2"), ends("ic", put="iqU"), only=("ic",)),
            step(ends("iv", "r2", mark="at"), ends("eus", "r2"), ends("eus", "r1", "eux"), ends("abl iqU", "r2"), ends("ièr Ièr", "rv", "i"), only=("ement",)),
            step(ends("abil", "r2"), ends("abil", put="abl"), ends("ic", "r2"), ends("ic", put="iqU"), ends("iv", "r2"), only=("ité",)),
            step(ends("at", "r2", mark="atic"), only=("at",)),
            step(ends("ic", "r2"), ends("ic", put="iqU"), only=("atic",)),
            step(
                ends("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it", before="[^aeiouyâàëéêèïîôûù]", mark="verb"),
                within="rv", only=("", "adverb"),
            ),
            step(
                ends("ions", "r2", mark="verb"), ends("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez", mark="verb"),
                ends("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions", mark="e"),
                within="rv", only=("", "adverb"),
            ),
            step(ends("e", "rv", mark="verb"), only=("e",)),
            Swap("Y$", "i", only=("done", "verb", "e", "ic", "at", "atic", "ement", "ité")), Swap("ç$", "c", only=("done", "verb", "e", "ic", "at", "atic", "ement", "ité")),
            Swap("(?<=[^aiouès])s$", "", only=("", "adverb")),
            step(ends("ion", "r2", "", "[st]"), ends("ier ière Ier Ière", "rv", "i"), ends("e", "rv"), only=("", "adverb")),
            Swap("(enn|onn|ett|ell|eill)$", "$1|"), Swap("(?:.)\\|$", ""),
            Swap("[éè](?=[^aeiouyâàëéêèïîôûù]+$)", "e"),
            Swap("U", "u"), Swap("I", "i"), Swap("Y", "y"),
        ),
    ),
    "ru": Rules(
        "аеиоуыэюя",
        first=(Swap("ё", "е"),),
        rv="^.*?[аеиоуыэюя]",
        short=2,
        steps=(
            step(ends("в вши вшись", before="[ая]", mark="gerund"), ends("ив ивши ившись ыв ывши ывшись", mark="gerund"), within="rv", fresh=True),
            step(ends("ся сь", mark=""), within="rv", only=("",)),
            step(ends("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею", mark="adjective"), within="rv", only=("",)),
            step(ends("ем нн вш ющ щ", before="[ая]"), ends("ивш ывш ующ"), within="rv", only=("adjective",)),
            step(
                ends("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", before="[ая]", mark="verb"),
                ends("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю", mark="verb"),
                within="rv", only=("",),
            ),
            step(ends("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я", mark="noun"), within="rv", only=("",)),
            step(ends("и"), within="rv", fresh=True),
            step(ends("ост ость", "r2"), fresh=True),
            step(ends("нн", put="н"), ends("ейш ейше", mark="superlative"), ends("ь"), within="rv", fresh=True),
            step(ends("нн", put="н"), within="rv", only=("superlative",)),
        ),
    ),
}
# Words that the English rules would get wrong.
EXCEPTIONS = {"en": {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split()}}
# English beginnings after which r1 starts.
ENGLISH_R1 = "^(?:gener|commun|arsen)"


def _length(word: Column, pattern: str) -> Column:
    """Letters of the pattern's match at the word's start, or of the whole word where there is none."""
    found = F.length(F.regexp_extract(word, pattern, 0))
    return F.when(found > 0, found).otherwise(F.length(word))


def _applied(rows: DataFrame, s: Step | Swap) -> DataFrame:
    stem, mark = F.col("stem"), F.col("mark")
    if isinstance(s, Swap):
        new = F.regexp_replace(stem, s.pattern, s.put)
        return rows.withColumn("stem", F.when(mark.isin(*s.only), new).otherwise(stem) if s.only else new)
    if s.fresh:
        rows = rows.withColumn("mark", F.lit(""))
    endings = sorted({e for g in s.groups for e in g.endings.split()}, key=len, reverse=True)
    inside = F.substr(stem, F.col(s.within) + 1) if s.within else stem
    rows = rows.withColumn("m", F.regexp_extract(inside, f"(?:{'|'.join(endings)})$", 0))
    base = F.left(stem, F.length(stem) - F.length("m"))
    out, left = F.when(F.lit(False), F.struct(stem.alias("stem"), mark.alias("mark"))), F.lit(True)
    for g in s.groups:
        hit = F.col("m").isin(*g.endings.split())
        if g.region:
            hit &= F.length(base) >= F.col(g.region)
        if g.before:
            hit &= base.rlike(f"(?:{g.before})$")
        new = F.struct(stem.alias("stem"), mark.alias("mark")) if g.put is None else F.struct(F.concat(base, F.lit(g.put)).alias("stem"), F.lit(g.mark).alias("mark"))
        out = out.when(hit & left, new)
    allowed = mark.isin(*s.only) if s.only else F.lit(True)
    rows = rows.withColumn("m", F.when(allowed, out))
    return rows.withColumns({"stem": F.coalesce("m.stem", "stem"), "mark": F.coalesce("m.mark", "mark")})


def _stemmed(rows: DataFrame, language: str) -> DataFrame:
    """``word, stem`` of one language's distinct words."""
    r = RULES[language]
    vowel, other = f"[{r.vowels}]", f"[^{r.vowels}]"
    rows = rows.select("word", F.regexp_replace("word", "’", "'").alias("stem"), F.lit("").alias("mark"))
    rows = reduce(_applied, r.first, rows)
    after = f"^.*?{vowel}.*?{other}"
    r1 = _length(F.col("stem"), after)
    if language == "en":
        r1 = F.when(F.col("stem").rlike(ENGLISH_R1), F.length(F.regexp_extract("stem", ENGLISH_R1, 0))).otherwise(r1)
    rows = rows.withColumn("r1", r1)
    rest = F.regexp_extract(F.substr("stem", F.col("r1") + 1), after, 0)
    rows = rows.withColumn("r2", F.when(F.length(rest) > 0, F.col("r1") + F.length(rest)).otherwise(F.length("stem")))
    # r2 follows the first r1, also where r1 itself must begin later
    rows = rows.withColumn("rv", _length(F.col("stem"), r.rv) if r.rv else F.lit(0)).withColumn("r1", F.greatest("r1", F.lit(r.least)))
    stem = F.col("stem")
    rows = reduce(_applied, r.steps, rows)
    own = F.create_map(*(F.lit(x) for pair in EXCEPTIONS[language].items() for x in pair)) if language in EXCEPTIONS else None
    stem = F.when(F.length("word") < r.short, F.col("word")).otherwise(F.col("stem"))
    return rows.select("word", F.coalesce(F.get(F.transform(F.array("word"), lambda w: F.try_element_at(own, w)), 0), stem).alias("stem") if own is not None else stem.alias("stem"))


def stem_table(words: DataFrame) -> DataFrame:
    """``language, word, stem`` of the distinct lower-case words (``language, word``); of other languages each word is its own stem.

    Null words are left out, and a null language counts as empty. A language's steps run over its own words only.
    """
    from tidings.operators.storage import materialize

    rows = materialize(words.select(F.coalesce("language", F.lit("")).alias("language"), "word").filter("word is not null").distinct(), "words")
    out = rows.filter(~F.col("language").isin(*RULES)).select("language", "word", F.col("word").alias("stem"))
    present = {r.language for r in rows.filter(F.col("language").isin(*RULES)).select("language").distinct().collect()}  # of RULES only
    for language in sorted(present):
        own = _stemmed(rows.filter(F.col("language") == language), language)
        out = out.unionByName(own.select(F.lit(language).alias("language"), "word", "stem"))
    return out


def stemmer(language: str) -> Callable[[str], str]:
    """The stem of one lower-case word of the language, the same as by ``stem_table``; a word of another language is its own."""
    r = RULES.get(language)
    if r is None:
        return lambda word: word
    own, after = EXCEPTIONS.get(language, {}), re.compile(f"^.*?[{r.vowels}].*?[^{r.vowels}]")
    rv_end, early = re.compile(r.rv) if r.rv else None, re.compile(ENGLISH_R1) if language == "en" else None

    def prepared(s: Step | Swap) -> tuple:
        if isinstance(s, Swap):
            return s.only, False, "", None, (re.compile(s.pattern), re.sub(r"\$(\d)", r"\\g<\1>", s.put))
        by_ending: dict[str, list] = {}
        for g in s.groups:
            for e in dict.fromkeys(g.endings.split()):
                by_ending.setdefault(e, []).append((g.region, re.compile(f"(?:{g.before})$").search if g.before else None, g.put, g.mark))
        return s.only, s.fresh, s.within, sorted({len(e) for e in by_ending}, reverse=True), by_ending

    first, steps = [prepared(s) for s in r.first], [prepared(s) for s in r.steps]

    def run(stem: str, mark: str, todo: list, at: dict[str, int]) -> tuple[str, str]:
        for only, fresh, within, lengths, what in todo:
            if fresh:
                mark = ""
            if only and mark not in only:
                continue
            if lengths is None:
                stem = what[0].sub(what[1], stem)
                continue
            most = len(stem) - at[within] if within else len(stem)
            for n in lengths:
                if n <= most and (groups := what.get(stem[-n:])):
                    base = stem[:-n]
                    for region, before, put, left in groups:
                        if (not region or len(base) >= at[region]) and (before is None or before(base)):
                            if put is not None:
                                stem, mark = base + put, left
                            break
                    break
        return stem, mark

    def reach(found: re.Match | None, otherwise: int) -> int:
        return found.end() if found and found.end() else otherwise

    def stem_of(word: str) -> str:
        if word in own:
            return own[word]
        if len(word) < r.short:
            return word
        stem, mark = run(word.replace("’", "'"), "", first, {})
        size = len(stem)
        r1 = reach(after.search(stem), size)
        if early and (found := early.search(stem)):
            r1 = found.end()
        rest = reach(after.search(stem[r1:]), 0)
        at = {"r1": max(r1, r.least), "r2": r1 + rest if rest else size, "rv": reach(rv_end.search(stem), size) if rv_end else 0}
        return run(stem, mark, steps, at)[0]

    return stem_of
