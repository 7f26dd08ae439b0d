"""An English normaliser for word error rates: spoken forms that mean the same become one text.

The order: brackets and fillers go, contractions and titles open, marks and accents go, number words become digits,
British spellings become American by rules (or by a map of the caller's, tried first), and spaces are evened out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fillers that go; contractions and titles with what they stand for, tried in this order.
FILLERS = ("hmm", "mm", "mhm", "mmm", "uh", "um")
WHOLE = (
    ("won't", "will not"), ("can't", "can not"), ("let's", "let us"), ("ain't", "aint"), ("y'all", "you all"), ("wanna", "want to"), ("gotta", "got to"), ("gonna", "going to"),
    ("i'ma", "i am going to"), ("imma", "i am going to"), ("woulda", "would have"), ("coulda", "could have"), ("shoulda", "should have"), ("ma'am", "madam"),
    ("mr", "mister"), ("mrs", "missus"), ("st", "saint"), ("dr", "doctor"), ("prof", "professor"), ("capt", "captain"), ("gov", "governor"), ("ald", "alderman"), ("gen", "general"), ("sen", "senator"),
    ("rep", "representative"), ("pres", "president"), ("rev", "reverend"), ("hon", "honorable"), ("asst", "assistant"), ("assoc", "associate"), ("lt", "lieutenant"), ("col", "colonel"), ("jr", "junior"), ("sr", "senior"), ("esq", "esquire"),
)
ENDINGS = (("'d been", " had been"), ("'s been", " has been"), ("'d gone", " had gone"), ("'s gone", " has gone"), ("'d done", " had done"), ("'s got", " has got"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"))
#: Letters that no decomposition brings to ASCII.
LETTERS = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ł", "l"))

#: Stems and words that a rule of morphology would change and must not: they are marked while the rules run.
_KEPT_ISE = "advert|(?:re|ill|pre)?adv|ar|chast|circumc|conc|dem|desp|dev|(?:private)?enterpr|exc|inc|exerc|expert|(?:en|disen)?franch|improv|merchand|parad|prec|imprec|prem|(?:com|unpre)?prom|compr|appr|repr|(?:unre)?rev|(?:sun|moon|up|high|low|a)r|superv|surm|surpr|unsurpr|telev|treat|[a-z]*w|val|chem|mort|cer|an|den|el"
_KEPT_LL = "(?:un|de|re|self)?controll|patroll|enroll|unroll|(?:steam)?roll|extoll|compell|expell|propell|repell|rebell|excell|dispell|impell|misspell|respell|quell|squall|(?:fore|re|story|fortune)tell|(?:re|out|up|best|over|under|cross)sell|(?:re|un)?install|forestall|recall|appall|befall|enthrall|annull|(?:un)?fulfill|(?:re|over|in|out|un|land)?fill|(?:un|good)?will|distill|instill|chancell|overkill|(?:de|up|re|un)?skill|over?spill"
KEPT = (
    rf"(?:{_KEPT_ISE})is(?:e|ed|es|ing|er|ers|ation|ations|able)",
    rf"(?:{_KEPT_LL})(?:ed|ing|ings|er|ers|or|ors|ist|ists|ous|ously|ery)",
    "(?:con|de|para|trouba|pompa|par|tam|vel|dev|am|glam|out|down|(?:ex)?vol)?(?:tour|dour|amour|kour|bour|our|vour|pour)(?:s|ed|ing|er|ers)?",
)
#: Spelling rules of morphology: (what stands before, British part, American part, what may follow), of whole words.
RULES = (
    ("[a-z]*[aeiouy][a-z]*[b-df-hj-np-tv-z]i?", "our", "or", "(?:s|ed|ing|ings|ite|ites|itism|able|ably|er|ers|ful|fully|less|hood|hoods|ly|liness|some|ist|ists|y|ies|al|man|men)?"),
    ("[a-z]*[aeiouy][a-z]*[b-df-hj-np-tv-z]i?", "ouris", "oriz", "(?:e|ed|es|ing|er|ers|ation)"),
    ("pract", "is", "ic", "(?:e|ed|es|ing|er|ers)"),
    ("[a-z]*[aeiouy][a-z]*[b-df-hj-np-tv-z]", "is", "iz", "(?:e|ed|es|ing|er|ers|ation|ations|ational|able)"),
    ("[a-z]*(?:anal|paral|catal|hydrol|electrol|dial)", "ys", "yz", "(?:e|ed|es|ing|er|ers)"),
    ("(?:kilo|centi|milli|nano|micro|deci|hecto)?(?:met|lit)|(?:epi)?cent|(?:amphi)?theat|fib|calib|sab|spect|meag|somb|lust|lac?klust|och|mit|goit|scept|sepulch|saltpet|reconnoit|accout|maneuv|manoeuv|louv|nit|tit|philt|salti?p?et", "re", "er", "s?"),
    ("(?:cent|sab|met|lust|mit|calib)", "red", "ered", ""),
    ("catal|dial|anal|monol|prol|epil|travel|homol|pedag|demag", "ogue", "og", "(?:s|d|r|rs)?"),
    ("catal", "oguing", "oging", ""),
    ("[a-z]*[aeiou][a-z]*[aeiou]", "ll", "l", "(?:ed|ing|ings|er|ers|or|ors|ist|ists|ous|ously|ery)"),
    ("tranqui", "lli", "li", "(?:ty|se|sed|ser|sers|sing|ze|zed|zer|zers|zing)"),
    ("def|off|pret|lic", "ence", "ense", "(?:s|d|less|lessness)?"),
    ("[a-z]*", "aemi", "emi", "(?:a|as|c|cs)"),
    ("[a-z]*", "haem", "hem", "[a-z]+"),
    ("[a-z]*", "paed", "ped", "[a-z]+"),
    ("(?:an)?", "aesth", "esth", "[a-z]+"),
    ("[a-z]*", "oestr", "estr", "[a-z]+"),
    ("", "oe", "e", "(?:dema|demas|sophag[a-z]+)"),
    ("f", "oet", "et", "[a-z]+"),
    ("f", "aec", "ec", "[a-z]+"),
    ("gyn|arch|pal|c", "ae", "e", "(?:c|o|s)[a-z]+"),
    ("medi", "aeval", "eval", "[a-z]*"),
    ("hom", "oeo", "eo", "[a-z]+"),
    ("[a-z]*rrh", "oe", "e", "a[a-z]*"),
    ("man", "oeuv", "euv", "[a-z]+"),
    ("maneuv", "r", "er", "(?:ed|ing|ings|able|ability)"),
    ("[a-z]*", "sulph", "sulf", "[a-z]*"),
    ("[a-z]*gram", "me", "", "s?"),
    ("s?m", "ould", "old", "(?:s|ed|ing|ings|y|ier|iest|er|ered|ering|ers)?"),
    ("m", "oult", "olt", "(?:s|ed|ing)?"),
    ("pl|snowpl", "ough", "ow", "(?:s|ed|ing|man|men|share|shares)?"),
    ("", "sceptic", "skeptic", "[a-z]*"),
    ("gr", "ey", "ay", "(?:s|er|est|ed|ing|ish|ness|scale)?"),
    ("", "draught", "draft", "(?:s|y|ier|iest|iness|ily|sman|smen|smanship|swoman|swomen)?"),
    ("(?:mis)?judg|acknowledg|abridg|lodg|prejudg", "em", "m", "ent(?:s|al)?"),
    ("ful", "fil", "fill", "(?:s|ment)?"),
    ("en", "rol", "roll", "(?:s|ment|ments)?"),
    ("in", "stal", "stall", "(?:s|ment|ments)?"),
    ("app|enthr", "al", "all", "(?:s|ment)?"),
    ("dist|inst", "il", "ill", "s?"),
    ("sk|w", "ilful", "illful", "(?:ly|ness)?"),
    ("worship|kidnap", "p", "", "(?:ed|ing|ings|er|ers)"),
    ("[a-z]*[aeiou][kvzl]", "ea", "a", "ble"),
    ("t", "yre", "ire", "s?"),
    ("ch", "eque", "eck", "(?:s|book|books)?"),
    ("ch", "equer", "ecker", "(?:s|ed|ing|board|boards)?"),
    ("", "aero", "air", "planes?"),
    ("", "mum", "mom", "(?:s|my|mies)?"),
    ("", "kerb", "curb", "(?:s|side)?"),
    ("m", "oustach", "ustach", "(?:e|es|ed|io|ios)"),
    ("c", "os", "oz", "(?:y|ier|iest|ily|iness|ies)"),
    ("y", "oghourt|oghurt", "ogurt", "s?"),
)
#: Words that no rule covers.
SPELLINGS = {
    "aluminium": "aluminum", "jewelery": "jewelry", "pyjamas": "pajamas", "pyjama": "pajama", "licence": "license", "ageing": "aging", "artefact": "artifact", "artefacts": "artifacts", "storey": "story", "storeys": "stories", "gaol": "jail", "gaols": "jails", "gaoled": "jailed", "tonne": "ton", "tonnes": "tons", "aeon": "eon", "aeons": "eons", "axe": "ax", "woollen": "woolen", "woollens": "woolens", "pedlar": "peddler", "pedlars": "peddlers", "speciality": "specialty", "specialities": "specialties", "carburettor": "carburetor", "carburettors": "carburetors", "centring": "centering", "cypher": "cipher", "cyphers": "ciphers", "dyke": "dike", "dykes": "dikes", "furore": "furor", "omelette": "omelet", "omelettes": "omelets", "phoney": "phony", "furores": "furors",
}

#: Number words.
SMALL = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {"oh": 0}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
LARGE = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
ORDINALS = {"first": ("one", "st"), "second": ("two", "nd"), "third": ("three", "rd"), "fifth": ("five", "th"), "eighth": ("eight", "th"), "ninth": ("nine", "th"), "twelfth": ("twelve", "th"), "twentieth": ("twenty", "th"), "thirtieth": ("thirty", "th"), "fortieth": ("forty", "th"), "fiftieth": ("fifty", "th"), "sixtieth": ("sixty", "th"), "seventieth": ("seventy", "th"), "eightieth": ("eighty", "th"), "ninetieth": ("ninety", "th")}
UNITS = {"percent": ("", "%"), "dollar": ("$", ""), "dollars": ("$", ""), "pound": ("£", ""), "pounds": ("£", ""), "euro": ("€", ""), "euros": ("€", ""), "cent": ("¢", ""), "cents": ("¢", "")}


def _ordinal(word: str) -> tuple[str, str] | None:
    if word in ORDINALS:
        return ORDINALS[word]
    stem = word.removesuffix("th")
    return (stem, "th") if word.endswith("th") and (stem in SMALL or stem in LARGE or stem == "hundred") else None


def _value(run: list[str]) -> str:
    """Digits of a run of cardinal words. Words that can't go together are set side by side: nineteen ninety, one oh one."""
    groups: list[list[int]] = []
    whole = part = 0
    told, room = False, 0
    for w in run:
        if w == "and":
            continue
        if w == "hundred":
            part, room, told = max(part, 1) * 100, 100, True
        elif w in LARGE:
            whole, part, room, told = whole + max(part, 1) * LARGE[w], 0, LARGE[w], True
        else:
            n = TENS.get(w, SMALL.get(w, 0))
            fits = not told or (n < room and (part == 0 or part % 100 == 0 or (part % 10 == 0 and 0 < n < 10 and part % 100 >= 20)))
            if not fits:
                groups.append([whole + part])
                whole = part = 0
            part, told = part + n, True
            room = 100 if w in TENS and n else 0 if n < 10 and part % 100 < 20 and not whole and part < 100 else room or 10
            if w in TENS:
                room = 10
    return "".join(str(g[0]) for g in groups) + str(whole + part)


def number_words(text: str) -> str:
    """Number words of a normalised English text as digits: cardinals, ordinals, decimals, halves, percents and money."""
    words, out, i = text.split(), [], 0
    plain = lambda w: w in SMALL or w in TENS or w in LARGE or w == "hundred"
    while i < len(words):
        if not plain(words[i]) and not (_ordinal(words[i]) and words[i] != "second"):
            out.append(words[i])
            i += 1
            continue
        run, tail = [], ""
        while i < len(words):
            w = words[i]
            if plain(w) or (w == "and" and run and (run[-1] == "hundred" or run[-1] in LARGE) and i + 1 < len(words) and (plain(words[i + 1]) or _ordinal(words[i + 1]))):
                run.append(w)
                i += 1
            elif (o := _ordinal(w)) and (run or w != "second"):
                run.append(o[0])
                tail = o[1]
                i += 1
                break
            else:
                break
        value = _value(run)
        if not tail and words[i : i + 1] == ["point"] and i + 1 < len(words) and (words[i + 1] in SMALL or words[i + 1].isdigit()):
            i += 1
            value += "."
            while i < len(words) and (words[i] in SMALL or words[i].isdigit()):
                value += str(SMALL.get(words[i], words[i]))
                i += 1
        elif not tail and words[i : i + 3] == ["and", "a", "half"]:
            value, i = str(float(Fraction(int(value)) + Fraction(1, 2))), i + 3
        if tail.endswith("d") or tail in ("st", "th"):
            # eleventh, twelfth and thirteenth end in th whatever their last digit
            value += tail
        if not tail and i < len(words) and words[i] in UNITS:
            before, after = UNITS[words[i]]
            value, i = before + value + after, i + 1
        out.append(value)
    return " ".join(out)


def _plain(text: str) -> str:
    """Accents off, marks and symbols to spaces but for those that numbers need."""
    return "".join(c if c in ".%$¢€£" else "" if unicodedata.category(c) == "Mn" else " " if unicodedata.category(c)[0] in "MSP" else c for c in unicodedata.normalize("NFKD", text))


@F.arrow_udf(T.StringType())
def _folded(texts: pa.Array) -> pa.Array:
    """Texts without accents and marks and with digits for number words; one small step a text, in Arrow batches."""
    return pa.array([None if t is None else number_words(_plain(t)) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _bare(texts: pa.Array) -> pa.Array:
    """The same with number words left as they are."""
    return pa.array([None if t is None else " ".join(_plain(t).split()) for t in texts.to_pylist()], pa.string())


def _pairs(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.regexp_replace(c, a, b)
    return c


def american(c: Column, spellings: Mapping[str, str] | None = SPELLINGS) -> Column:
    """Words of a text in American spelling; None leaves them as they are."""
    if spellings is None:
        return c
    c = _pairs(c, [(rf"\b({'|'.join(KEPT)})\b", "$1_")])
    c = _pairs(c, [(rf"\b({stems})(?:{british})({after})\b", f"$1{new}$2") for stems, british, new, after in RULES])
    c = F.translate(c, "_", "")
    words = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " ", -1), lambda w: F.coalesce(words[w], w)), " ")


def opened(c: Column) -> Column:
    """Lower case; brackets and fillers gone, contractions and titles opened, separators of thousands and full stops gone."""
    c = _pairs(F.lower(c), [(r"[<\[][^>\]]*[>\]]", ""), (r"\(([^)]+?)\)", "")])
    c = _pairs(c, [(r"(?U)\b(" + "|".join(FILLERS) + r")\b", ""), (r"(?U)\s+'", "'")])
    c = _pairs(c, [(rf"(?U)\b{a}\b", b) for a, b in WHOLE])
    c = _pairs(c, [(rf"(?U){a}\b", b) for a, b in ENDINGS])
    c = _pairs(c, [(r"(\d),(\d)", "$1$2"), (r"\.([^0-9]|$)", " $1")])
    for a, b in LETTERS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def norm_english(c: Column, spellings: Mapping[str, str] | None = SPELLINGS, numbers: bool = True) -> Column:
    """The normal form of an English text; null stays null. Without spellings words keep their own (other scores!), and
    without ``numbers`` number words do."""
    c = american((_folded if numbers else _bare)(opened(c)), spellings)
    c = _pairs(c, [(r"[.$¢€£]([^0-9])", " $1"), (r"([^0-9])%", "$1 ")])
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
