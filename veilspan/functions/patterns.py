"""Patterns of the detectors, in Java's syntax; every one sees Unicode classes, as (?U) asks for.

SQL engines with RE2 know neither look-around nor Unicode boundaries: PLAIN has, for the same detector, a form for them.
"""

from __future__ import annotations

# Accents are optional in these words; a blank stands for any white space or none; order decides.
NAME_LABELS = (
    r"szül(?:etési)? névé?", r"leánykori névé?", r"anyja névé?", r"anyánév", r"anyja szül(?:etési)? névé?", r"a\. név", r"beteg névé?", r"páciens névé?",
    r"kezelt névé?", r"vizsgált személy", r"vizsgált névé?", r"ellátott névé?", r"gondozott névé?", r"ügyfél névé?", r"kliensnév", r"kliens névé?", r"név",
    r"biztosított névé?", r"törvényes képviselő névé?", r"hozzátartozó névé?", r"kapcsolattartó névé?", r"beutaló orvos", r"kérő orvos", r"házi orvos",
    r"beküldő orvos", r"kezelő orvos", r"validáló", r"vizsgálatot végezte", r"leletező orvos", r"alulírott",
)
# Words of titles, addresses, dates, records and contexts.
TITLES = ("optometrista", "kontaktológus", "szakorvos", "adjunktus", "főorvos", "orvos", "rezidens", "asszisztens", "szakasszisztens", "védőnő", "gyógytornász")
STREETS = ("utca", "út", "tér", "körút", "fasor", "köz", "sor", "dűlő", "major", "telep", "lakótelep", "sétány", "rakpart")
MONTHS = ("január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december")
RECORD_LABELS = (r"napló(?:sor)?szám", "sorszám", "ambuláns lap szám", "munkaszám", "védettségi igazolvány szám")
BIRTH = (r"születési (?:dátum|idő|hely)", r"szül\.? (?:dát|idő)?", "született", r"sz\. d\.", r"sz\. idő?", "born", r"dátum :? szül", r"szül\. dát")
TAJ_CONTEXT = (r"taj[-\s]?szám", "társadalombiztosítási", "tb szám", "biztosítási szám")
UPPER, LOWER = "A-ZÁÉÍÓÖŐÚÜŰ", "a-záéíóöőúüű"
SUFFIXES = "n on en ön ra re ára ére ba be ban ben ból ből ról ről tól től nál nél hoz hez höz nak nek val vel ért ig kor ként vá vé".split()
PLACEHOLDERS = {
    "NAME": "[REDACTED_NAME]", "TAJ": "[REDACTED_TAJ]", "PHONE": "[REDACTED_PHONE]", "EMAIL": "[REDACTED_EMAIL]", "DATE_OF_BIRTH": "[REDACTED_DOB]", "ADDRESS": "[REDACTED_ADDRESS]",
    "LOCATION": "[REDACTED_LOCATION]", "ORGANIZATION": "[REDACTED_ORG]", "DOCTOR_ID": "[REDACTED_DOCTOR_ID]", "COMPANY_ID": "[REDACTED_COMPANY_ID]", "RECORD_ID": "[REDACTED_RECORD_ID]",
}
#: Each accented vowel and the plain one that stands for it.
PLAIN_VOWELS = dict(zip("áéíóöőúüű", "aeiooouuu", strict=True))


def either(words: tuple[str, ...]) -> str:
    """An alternation of the words, with or without accents, any white space for a blank."""
    joined = "|".join(words).replace(" ", r"\s*")
    return "(?:" + "".join(f"[{PLAIN_VOWELS[c]}{c}]" if c in PLAIN_VOWELS else c for c in joined) + ")"


def names(gap: str, least: int, most: int, mixed: bool) -> str:
    """least + 1 to most + 1 name parts with the shortest gaps; mixed: parts in capitals among others, else all or none."""
    part, caps = f"[{UPPER}][{LOWER}]+(?:n[eé])?", f"[{UPPER}]{{2,}}(?:N[EÉ])?"
    run = lambda p: f"(?:{p}{gap}){{{least},{most}}}{p}"
    if mixed:
        p = f"(?:{part}|{caps})"
        return f"{p}(?:{gap}{p}){{{least},{most}}}"
    return f"(?:{run(part)}|{run(caps)})"


# Fixed values below: the patterns decide what is found.
PART = f"[{UPPER}][{LOWER}]+(?:n[eé])?"
FULL = names(r"[\s\n\-–—\.]+?", 1, 4, False)
ONE_PLUS, TWO_PLUS, THREE = (names(r"[ \t\-–—.]+?", least, most, True) for least, most in ((0, 4), (1, 4), (1, 2)))
SEP, RECORD_SEP = r"[\s:.|·…\n]*[:\|]?[\s.·…\n]*", r"[\s_:.|·…\n]*[:\|]?[\s_.·…\n]*"

#: Detectors in their order: (name, label, where the span stands in the match, pattern).
#: whole: the match; head, tail: group 1 begins or ends it; middle: white space and one more character follow group 1.
DETECTORS = (
    ("taj", "TAJ", "whole", r"(?U)\b\d{3}[-\s]?\d{3}[-\s]?\d{3}\b"),
    ("phone", "PHONE", "whole", r"(?U)(?:\+36|06)[-\s.]?(?:1|[2-9]\d)[-\s.]?\d{3}[-\s.]?\d{2,4}|\b(?:20|30|31|50|70)\s?/\s?\d{3}[-\s.]?\d{4}\b|\(\s*(?:06|1|[2-9]\d)\s*\)\s*\d{2}\s*[-–—]\s*\d{3}\s*[-–—]\s*\d{3,4}\b|\b(?:1|[2-9]\d)\s*/\s*\d{3}\s*[-–—]\s*\d{3,4}(?:\s*/\s*\d{1,4})?\b"),
    ("email", "EMAIL", "whole", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("dob_numeric", "DATE_OF_BIRTH", "whole", r"(?U)\b(?:19|20)\d{2}[.\-/]\s?(?:0[1-9]|1[0-2])[.\-/]\s?(?:0[1-9]|[12]\d|3[01])\.?\b"),
    ("dob_text", "DATE_OF_BIRTH", "whole", rf"(?iU)\b(?:19|20)\d{{2}}\.?\s*{either(MONTHS)}\s*\d{{1,2}}\.?\b"),
    ("address_street", "ADDRESS", "whole", rf"(?iU)\b[{UPPER}][{LOWER}]+\s+{either(STREETS)}\s*\d+[./\-]?\s*\d*"),
    ("address_postal", "ADDRESS", "whole", rf"(?U)\b[1-9]\d{{3}}\s+[{UPPER}][{LOWER}]+"),
    ("name_field", "NAME", "tail", rf"(?iU)(?<![{LOWER}]){either(NAME_LABELS)}{SEP}(?-i:({FULL}))"),
    ("name_table", "NAME", "middle", rf"(?iU)\|\s*{either(NAME_LABELS)}\s*\|\s*(?-i:({FULL}))\s*\|"),
    ("name_dr_prefix", "NAME", "tail", rf"(?U)\b[Dd][Rr]\b\.?[ \t]*({ONE_PLUS})"),
    ("name_dr_suffix", "NAME", "head", rf"(?U)({TWO_PLUS})[ \t]+[Dd][Rr]\.?(?![A-Za-z])"),
    ("name_title", "NAME", "head", rf"(?U)({TWO_PLUS})[ \t]+(?i:{either(TITLES)})\b"),
    ("name_reszere", "NAME", "head", rf"(?U)({THREE})[ \t]+(?i:r[eé]sz[eé]re)\b"),
    ("doctor_eeszt", "DOCTOR_ID", "tail", r"(?iU)\bEESZT\s*:?\s*\(?\s*([A-Z]?\d{4,7})\b"),
    ("doctor_paren", "DOCTOR_ID", "middle", rf"(?U){PART}\s*\.?\s*\(\s*(?:azonos[ií]t[oó]\s*:?\s*)?([A-Z]?\d{{5,7}})\s*\)"),
    ("doctor_stamp", "DOCTOR_ID", "tail", rf"(?U){PART}\s+([A-Z]\d{{5}})\b"),
    ("company_registry", "COMPANY_ID", "whole", r"(?U)\b\d{2}-\d{2}-\d{6}\b"),
    ("company_tax", "COMPANY_ID", "whole", r"(?U)\b\d{8}-[1-5]-\d{2}\b"),
    ("record_label", "RECORD_ID", "tail", rf"(?iU)(?<![{LOWER}]){either(RECORD_LABELS)}a?{RECORD_SEP}([A-Z]?\d(?:[\d /–-]{{0,16}}\d){{3,}})"),
    ("record_composite", "RECORD_ID", "whole", r"(?U)\b\d{8,9}-(?:19|20)\d{2}-\d{7,8}\b"),
)
#: What a text must have for the detector to match in it: patterns that are cheap to look for, all of them.
YEAR = r"(?:19|20)\p{Nd}{2}"
LABELLED = r"(?iu)n[eé]v|orvos|szem[eé]ly|valid[aá]l[oó]|v[eé]gezte|alul[ií]rott"
NEEDS = {
    "taj": (r"\p{Nd}{3}",), "phone": (r"\+36|06|[/(]", r"\p{Nd}{3}"), "email": ("@",), "dob_numeric": (YEAR + r"[.\-/]",), "dob_text": (YEAR,),
    "address_street": (r"\p{Nd}", rf"(?iu){either(STREETS)}"), "address_postal": (r"[1-9]\p{Nd}{3}[^\p{L}\p{Nd}]",), "name_field": (LABELLED,), "name_table": (r"\|", LABELLED),
    "name_dr_prefix": (r"[Dd][Rr][. \t]",), "name_dr_suffix": (r"[ \t][Dd][Rr](?![A-Za-z])",), "name_title": (rf"(?iu)[ \t]{either(TITLES)}",), "name_reszere": (r"(?iu)[ \t]r[eé]sz[eé]re",),
    "doctor_eeszt": (r"(?iu)eeszt", r"\p{Nd}{4}"), "doctor_paren": (r"\(", r"\p{Nd}{5}"), "doctor_stamp": (r"[A-Z]\p{Nd}{5}",), "company_registry": (r"\p{Nd}{2}-\p{Nd}{2}-\p{Nd}",),
    "company_tax": (r"\p{Nd}{8}-",), "record_label": (r"(?iu)sz[aá]m", r"\p{Nd}"), "record_composite": (r"\p{Nd}{8}-",),
}
BARE_STAMP = r"(?U)\b[A-Z]?\d{5,6}\b"
BIRTH_CONTEXT, TAJ_BEFORE, INSTITUTION = f"(?iU){either(BIRTH)}", f"(?iU){either(TAJ_CONTEXT)}", r"(?iU)(?:NNGYK|NEAK)\s*:?\s*\(?\s*$"


def plain(pattern: str) -> str:
    """The pattern for RE2: what stands before a label is consumed, what must not follow as well."""
    out = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    return out.replace(f"(?<![{LOWER}])", f"(?:^|[^{LOWER}])").replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)")
