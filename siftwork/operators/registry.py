"""The detectors: 26 patterns with what is known of them.

Patterns are put together from word lists for Java's engine: flat, with explicit white space (SPACE) and letter boundaries, since \\b,
\\s and case folding differ between engines. (?iu) folds case in Unicode's way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from siftwork.functions.text import SPACE as S

D = "\\p{Nd}"
UP, LOW, RUS = "[А-ЯЁ]", "[а-яё]", "[А-ЯЁа-яё]"
END = "(?![\\p{L}\\p{N}_])"


def words(*alternatives: str) -> str:
    """One of some phrases; a blank stands for any white space."""
    return "(?:" + "|".join(a.replace(" ", f"{S}+") for a in alternatives) + ")"


@dataclass(frozen=True)
class Detector:
    number: int
    name: str
    category: str
    description: str
    pattern: str
    #: Literals of which every match has one, in lower case, and a cheap pattern that does as well as one of them.
    stems: tuple[str, ...] = ()
    gate: str = ""
    checked: bool = False
    special: bool = False
    biometric: bool = False
    min_length: int = 3
    #: Group of the probe for alias deduplication, where the detector has one.
    probe: str = ""


# The words and forms the detectors accept.
ROLES = words("ФИО", "Ф\\.И\\.О\\.", "фамилия", "заявитель(?:я|ю|ем|е)?", "сотрудник(?:а|у|ом|е)?", "работник(?:а|у|ом|е)?", "клиент(?:а|у|ом|е)?", "владелец", "держатель", "собственник", "представитель", "застрахованный", "получатель", "плательщик", "абонент")
SURNAME, FIRST, PATRONYMIC = f"{UP}{LOW}{{1,20}}-?{LOW}*", f"{UP}{LOW}{{1,15}}", f"{UP}{LOW}+(?:вич|вна|ович|овна|евич|евна)"
DAY, MONTH, YEAR = f"(?:0?[1-9]|[12]{D}|3[01])", "(?:0?[1-9]|1[0-2])", f"(?:19|20){D}{{2}}"
MONTHS = "(?:январ[яь]|феврал[яь]|март[аe]?|апрел[яь]|ма[йя]|июн[яь]|июл[яь]|август[аe]?|сентябр[яь]|октябр[яь]|ноябр[яь]|декабр[яь])"
STREETS = f"(?:ул(?:ица)?\\.?{S}*|пр(?:-?т|оспект)?\\.?{S}*|пер(?:еулок)?\\.?{S}*|бул(?:ьвар)?\\.?{S}*|наб(?:ережная)?\\.?{S}*|пл(?:ощадь)?\\.?{S}*|ш(?:оссе)?\\.?{S}*|тракт\\.?{S}*)"
PASSPORT = words("паспорт(?:а|е|у|ом)?", "passport", "пасп\\.?", "серия и номер", "документ №")
LICENSE = words("вод(?:ительское)? уд(?:остоверение)?", "в\\.у\\.", f"ву{END}", "driver.?licen[cs]e")
EXPIRY = words("срок действия", "действительна? до", "valid (?:thru|through|until)", "exp(?:iry|ires?)?\\.?")
ACCOUNT = words("р/?с", "расч(?:ётный|ет\\.|ет) счёт?", "bank account", "account")
BIOMETRIC = words("отпечат(?:ок|ки) пальц", "дактилоскопи", "сетчатк[аи] глаз", "радужн(?:ая|ой) оболочк", "рисунок вен", "геометри[ия] лиц", "распознавани[ея] лиц", "голосов(?:ой|ые) (?:образец|данные|биометр)", "face recognition", "fingerprint", "iris scan", "retina scan", "voice (?:print|sample)", "biometric")
HEALTH = words(
    "диагноз", "диагностика", "заболевани[ея]", "болезн[ьи]", "инвалидност[ьи]", f"инвалид{END}",
    "мед(?:ицинск(?:ий|ая|ое|ие))? (?:карт[аы]|заключени[ея]|справк[аи]|анализ|осмотр|история)", "история болезни", "амбулаторн(?:ая|ый) карт[аы]",
    "эпикриз", "выписк[аи] из (?:больниц|клиник)", f"рецепт{END}", "назначени[ея] врача", "группа крови", "вич", "спид", "hiv", "aids", "психиатри", "наркологи", "онкологи", "кардиологи",
)
RELIGION = words("вероисповедани[ея]", "религи(?:я|озн)", "православ", "католи", "ислам", "мусульман", "буддист", "иудей", "церков", "мечет[ьи]", "синагог", "атеист", "агностик", "religion", "faith", "muslim", "christian", "buddhist", "jewish")
POLITICAL = words("политическ(?:ие|их) взгляд", "политическ(?:ие|ие) убежден", "член (?:партии|профсоюза)", "партийн(?:ость|ая принадлежность)", "политическ(?:ая|ие) принадлежн")
ORIGIN = words("национальн(?:ость|ая принадлежность)", "расов(?:ая|ое) (?:принадлежность|происхождение)", "этническ(?:ое|ая) (?:происхождение|принадлежность)", f"этнос{END}", "этничность")
CRIMINAL = words("судим(?:ость|ости)", "уголовн(?:ое|ый) (?:дело|преследование|запись)", "привлекался к уголовной", "снят(?:ие|ие) судимости")

_i = "(?iu)"
# Names, categories, least lengths, and the forms each detector accepts, in the order in which detectors run.
_ROWS = [
    ("full_name_context", "full_name", "Name near a role word", f"{_i}{ROLES}[ \\t]*:?[ \\t]*\\n?[ \\t]*(?={UP})({SURNAME})[ \\t]+{FIRST}(?:[ \\t]+{PATRONYMIC})?", dict(min_length=10, probe="name")),
    ("full_name", "full_name", "Surname, first name, patronymic", f"(?<!{RUS})({SURNAME}){S}+{FIRST}{S}+{PATRONYMIC}(?!{RUS})", dict(min_length=10, probe="name")),
    ("initials_name", "full_name", "Surname with initials", f"(?:{SURNAME}{S}+{UP}\\.{UP}\\.|{UP}\\.{UP}\\.{S}+{SURNAME})", dict(gate="[А-ЯЁ]\\.[А-ЯЁ]\\.", min_length=7)),
    ("phone", "contact", "Telephone number", f"(?<!{D})(?:\\+7|8)(?:{S}|[-(])*{D}{{3}}(?:{S}|[-)])*{D}{{3}}(?:{S}|-)?{D}{{2}}(?:{S}|-)?{D}{{2}}(?!{D})", dict(min_length=10)),
    ("email", "contact", "Mail address", "(?<![A-Za-z0-9._%+\\-])[A-Za-z0-9._%+\\-]{1,64}@[A-Za-z0-9.\\-]{1,253}\\.[A-Za-z]{2,10}(?![A-Za-z0-9._%+\\-@])", dict()),
    ("date_of_birth", "birth_info", "Date of birth", f"{_i}(?:дата{S}+рождения|д\\.?{S}*р\\.?|дата{S}*[:]{S}*|birth(?:day|date)?(?:{S}|:)*|born(?:{S}|:)*|DOB(?:{S}|:)*)(?:{S}|:)*(?:{DAY}[.\\-/]{MONTH}[.\\-/]{YEAR}|{YEAR}-{MONTH}-{DAY})", dict(min_length=8)),
    ("date_verbal", "birth_info", "Date in words", f"{_i}(?<!{D}){DAY}{S}+{MONTHS}{S}+{YEAR}(?:{S}+года?)?", dict()),
    ("address", "address", "Postal address", f"{_i}(?<![А-ЯЁа-яёA-Za-z])(?:{STREETS}(?:[А-ЯЁа-яёA-Za-z0-9\\-.]|{S}){{2,50}}(?:,|{S})+(?:д(?:ом)?\\.?{S}*{D}+[а-яА-Я]?(?:/{D}+)?)?(?:(?:,|{S})+кв(?:артира)?\\.?{S}*{D}+)?)", dict(min_length=10)),
    ("postal_code", "address", "Postal code", f"{_i}(?:(?:почтовый{S}+)?индекс(?:{S}|:)*|(?:^|,|{S})(?:г\\.|город|обл\\.|область|р-н|район)(?:{S}|\\.)*[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+{S}*,{S}*)[1-6]{D}{{5}}(?!{D})", dict(min_length=6)),
    ("passport_rf", "government_id", "Passport series and number", f"{_i}{PASSPORT}(?:{S}|[:№#])*{D}{{2}}{S}?{D}{{2}}(?:{S}|-)?{D}{{6}}", dict(checked=True, probe="passport")),
    ("snils", "government_id", "Insurance number", f"{_i}(?<!{D})(?:{D}{{3}}(?:{S}|-){D}{{3}}(?:{S}|-){D}{{3}}(?:{S}|-){D}{{2}}|{words('снилс', 'snils', 'страховой номер')}(?:{S}|[:№#])*{D}{{11}})(?!{D})", dict(gate=f"{D}{{3}}", checked=True, min_length=11)),
    ("inn", "government_id", "Taxpayer number", f"{_i}{words('инн', 'inn', f'taxpayer(?: id)?')}(?:{S}|[:№#])*{D}{{10}}(?:{D}{{2}})?", dict(checked=True, min_length=10)),
    ("driver_license", "government_id", "Driving licence", f"{_i}{LICENSE}(?:{S}|[:№#])*(?:{D}{{2}}{S}?[А-ЯЁA-Z]{{2}}|{D}{{4}})(?:{S}|-)?{D}{{6}}", dict()),
    ("mrz", "government_id", "Machine-readable zone", "[A-Z0-9<]{30,44}", dict(gate="[A-Z0-9<]{30}", min_length=30)),
    ("card_number", "payment", "Bank card", f"(?<!{D})(?:{D}{{4}}(?:{S}|-){D}{{4}}(?:{S}|-){D}{{4}}(?:{S}|-){D}{{1,4}}|{D}{{4}}(?:{S}|-){D}{{6}}(?:{S}|-){D}{{5}})(?!{D})", dict(gate=f"{D}{{4}}", checked=True, min_length=16)),
    ("cvv", "payment", "Card verification code", f"{_i}(?:cvv|cvc|cvv2|cvc2|cv2|csc)(?:{S}|:)*{D}{{3,4}}", dict()),
    ("card_expiry", "payment", "Card expiry", f"{_i}{EXPIRY}(?:{S}|:)*(?<!{D})(?:0[1-9]|1[0-2])/(?:{D}{{2}}|{D}{{4}})(?!{D})", dict()),
    ("bank_account", "payment", "Bank account", f"{_i}{ACCOUNT}(?:{S}|[:№#])*{D}{{20}}", dict()),
    ("bic", "payment", "Bank code", f"{_i}(?:бик|bik|bic)(?:{S}|:)*04{D}{{7}}", dict()),
    ("iban", "payment", "International account", f"(?<![A-Z])[A-Z]{{2}}{D}{{2}}[A-Z0-9]{{4,30}}(?![A-Z0-9])", dict(gate=f"[A-Z]{{2}}{D}{{2}}")),
    ("biometric", "biometric", "Biometric sample", f"{_i}{BIOMETRIC}", dict(biometric=True)),
    ("health", "special", "Health", f"{_i}{HEALTH}", dict(special=True)),
    ("religion", "special", "Faith", f"{_i}{RELIGION}", dict(special=True)),
    ("political", "special", "Political views", f"{_i}{POLITICAL}", dict(special=True)),
    ("race_ethnicity", "special", "Origin", f"{_i}{ORIGIN}", dict(special=True)),
    ("criminal", "special", "Criminal record", f"{_i}{CRIMINAL}", dict(special=True)),
]

#: Stems by detector: every match has one of its detector's (fixed values, they follow from the words above).
STEMS = {
    "full_name_context": "фио ф.и.о. фамилия заявитель сотрудник работник клиент владелец держатель собственник представитель застрахованный получатель плательщик абонент",
    "full_name": "вич вна",
    "phone": "+7 8",
    "email": "@",
    "date_of_birth": "дата р birth born dob",
    "date_verbal": "январ феврал март апрел мая май июн июл август сентябр октябр ноябр декабр",
    "postal_code": "индекс г. город обл. область р-н район",
    "passport_rf": "паспорт passport пасп серия документ",
    "inn": "инн inn taxpayer",
    "driver_license": "вод в.у. ву driver",
    "cvv": "cvv cvc cv2 csc",
    "card_expiry": "срок действител valid exp",
    "bank_account": "р/с рс расч account",
    "bic": "бик bik bic",
    "biometric": "отпечат дактилоскопи сетчатк радужн рисунок геометри распознавани голосов face fingerprint iris retina voice biometric",
    "health": "диагно заболевани болезн инвалид мед история амбулаторн эпикриз выписк рецепт назначени группа вич спид hiv aids психиатри наркологи онкологи кардиологи",
    "religion": "вероисповедани религи православ католи ислам мусульман буддист иудей церков мечет синагог атеист агностик religion faith muslim christian buddhist jewish",
    "political": "политическ член партийн",
    "race_ethnicity": "национальн расов этни этнос",
    "criminal": "судим уголовн привлекался снят",
}

DETECTORS = [Detector(k + 1, n, c, d, p, stems=tuple(STEMS.get(n, "").split()), **more) for k, (n, c, d, p, more) in enumerate(_ROWS)]
BY_NAME = {d.name: d for d in DETECTORS}
CHECKED = frozenset(d.name for d in DETECTORS if d.checked)
HIGHEST = frozenset(d.name for d in DETECTORS if d.special or d.biometric)
SHORTEST = 3


def dimension(spark: SparkSession) -> DataFrame:
    """The registry as a table of 26 rows."""
    rows = [(d.number, d.name, d.category, d.description, d.checked, d.special, d.biometric, d.min_length) for d in DETECTORS]
    return spark.createDataFrame(rows, "pattern_no int, pattern_name string, category string, description string, requires_validation boolean, is_special_category boolean, is_biometric boolean, min_length int")
