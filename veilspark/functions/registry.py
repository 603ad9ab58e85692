"""Recognizers as data: types, tags, patterns with scores, context words.

Regular expressions are written with ASCII \\b, \\d and \\w. `python` compiles one for Python,
`java` rewrites it for Spark's engine, whose \\b knows all letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

# ---- fixed values: entity types and the tags of their placeholders ----
TAGS = {
    "PERSON": "PERSON",
    "ORGANIZATION": "ORG",
    "LOCATION": "LOCATION",
    "NRP": "NRP",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "URL": "URL",
    "IP_ADDRESS": "IP",
    "ID_DOC": "ID_DOC",
    "CREDIT_CARD": "CREDIT_CARD",
    "IBAN_CODE": "IBAN",
    "CRYPTO": "CRYPTO",
    "US_SSN": "US_SSN",
    "US_PASSPORT": "US_PASSPORT",
    "US_DRIVER_LICENSE": "US_DL",
    "UK_NHS": "UK_NHS",
    "UK_NIN": "UK_NIN",
    "UK_PASSPORT": "UK_PASSPORT",
    "UK_CRN": "UK_CRN",
    "UK_DRIVING_LICENCE": "UK_DL",
    "EU_VAT": "EU_VAT",
    "EU_PASSPORT": "EU_PASSPORT",
    "DE_TAX_ID": "DE_TAX",
    "DE_SOCIAL_SECURITY": "DE_SSN",
    "FR_NIR": "FR_NIR",
    "FR_CNI": "FR_CNI",
    "IT_FISCAL_CODE": "IT_CF",
    "IT_VAT": "IT_VAT",
    "ES_DNI": "ES_DNI",
    "ES_NIE": "ES_NIE",
    "CY_TIC": "CY_TIC",
    "CY_ID_CARD": "CY_ID",
    "MEDICAL_LICENSE": "MED_LIC",
}
TYPES = {tag: kind for kind, tag in TAGS.items()}
NAMED = frozenset({"PERSON", "ORGANIZATION", "LOCATION", "NRP"})
BOOST, CONTEXT_CHARS, MIN_SCORE = 0.35, 200, 0.30


@dataclass(frozen=True)
class Pattern:
    kind: str
    name: str
    score: float
    regex: str
    context: tuple[str, ...]

    @property
    def digits(self) -> bool:
        """Whether every match holds a digit."""
        return self.name not in ("email", "url", "ipv6", "org_caps_suffix", "org_mixed_suffix", "org_authority")


OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
CAPS_STOP = (
    "UNDER AND FOR WITH FROM BETWEEN BY OR BUT AFTER BEFORE THROUGH INTO UPON WHEREAS WHEREBY BEING HAVING ALSO EACH EVERY SUCH EXCEPT PURSUANT SUBJECT ACCORDING "
    "REGARDING HEREIN THEREOF UNLESS UNTIL DURING WITHIN WITHOUT AMONG AGAINST OF TO IN ON AT NOT IF SO NO AS IS BE IT AN DO UP CHANGE NAME WHERE WHEN WHILE SINCE "
    "ABOVE BELOW ONLY THAN THAT THIS DOES SHALL WILL MUST SHOULD WOULD COULD MAY MIGHT BEEN WERE WAS ARE HAS HAD DID ANY ALL THE AGREEMENT SALE PURCHASE SHARE SHARES "
    "DATED SCHEDULE CONTRACT DEED RESOLUTION NOTICE MEMORANDUM CERTIFICATE POWER ARTICLES"
).split()

# ---- fixed values: (type, context words, (name, score, regex) ...) in the order in which they are tried ----
RECOGNIZERS = [
    ("EMAIL_ADDRESS", "email|e-mail|mail|address|contact", [("email", 0.85, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")]),
    (
        "PHONE_NUMBER",
        "phone|telephone|tel|call|mobile|cell|fax|contact number",
        [
            ("phone_intl", 0.6, r"\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?[\s.\-]?\d{1,4}[\s.\-]?\d{1,4}(?:[\s.\-]\d{1,4})?\b"),
            ("phone_us_paren", 0.6, r"\(\d{3}\)\s?\d{3}[\s.\-]?\d{4}\b"),
            ("phone_us_sep", 0.55, r"\b\d{3}[\s.\-]\d{3}[\s.\-]\d{4}\b"),
            ("phone_long_bare", 0.2, r"\b\d{11,15}\b"),
        ],
    ),
    ("URL", "url|website|link|site|http|www", [("url", 0.6, r"\bhttps?:\/\/[^\s<>\"{}|\\^`\[\]]+")]),
    (
        "IP_ADDRESS",
        "IP|address|server|host|network",
        [("ipv4", 0.6, rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"), ("ipv6", 0.6, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b")],
    ),
    (
        "CREDIT_CARD",
        "credit card|card number|CC|Visa|MasterCard|Amex|payment",
        [
            ("cc_visa", 0.6, r"\b4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
            ("cc_mc", 0.6, r"\b5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
            ("cc_amex", 0.6, r"\b3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}\b"),
        ],
    ),
    ("IBAN_CODE", "IBAN|bank account|account number|bank transfer|SWIFT|BIC", [("iban", 0.7, r"\b[A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?(?:[\dA-Z]{4}[\s]?){1,7}[\dA-Z]{1,4}\b")]),
    ("CRYPTO", "bitcoin|ethereum|crypto|wallet|BTC|ETH|blockchain", [("btc", 0.5, r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"), ("eth", 0.6, r"\b0x[0-9a-fA-F]{40}\b")]),
    ("US_SSN", "SSN|social security|social security number", [("us_ssn", 0.5, r"\b\d{3}[\s-]\d{2}[\s-]\d{4}\b")]),
    ("US_PASSPORT", "passport|US passport|travel document|State Department", [("us_passport", 0.1, r"\b[A-Z]\d{8}\b")]),
    ("US_DRIVER_LICENSE", "driver's license|driver license|DL|DMV", [("us_dl", 0.1, r"\b[A-Z]\d{7,12}\b")]),
    ("UK_NHS", "NHS|NHS number|health service|patient number|medical record", [("uk_nhs", 0.3, r"\b\d{3}[\s-]?\d{3}[\s-]?\d{4}\b")]),
    ("UK_NIN", "national insurance|NI number|NIN|NINO|tax|HMRC|PAYE", [("uk_nin_spaced", 0.7, r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b")]),
    ("UK_PASSPORT", "passport|travel document|UK passport|HM Passport|HMPO", [("uk_passport", 0.1, r"\b\d{9}\b")]),
    (
        "UK_CRN",
        "company number|registration number|Companies House|CRN|registered number|company reg",
        [("uk_crn_numeric", 0.1, r"\b\d{8}\b"), ("uk_crn_alpha", 0.4, r"\b[A-Z]{2}\d{6}\b")],
    ),
    (
        "ID_DOC",
        "reg. no|reg no|registration no|registration number|registered number|company number|company no|organisation number|organization number|org. no|org no|"
        "business number|entity number|corporate identity number|CIN|ABN|TIN|DUNS|duns number|EIN|tax id|tax number|routing|sort code|account|acct",
        [
            ("reg_number", 0.05, r"\b\d[\d-]{4,11}\d\b"),
            ("reg_linebreak", 0.05, r"\b\d{4,8}-\s*\n\s*\d{3,6}\b"),
            ("reg_alpha", 0.05, r"\b[A-Z]{1,4}[-\s]?[A-Z]{0,3}[-\s]?\d{5,12}\b"),
        ],
    ),
    ("ID_DOC", "VAT|VAT number|VAT no|tax number|tax id|value added tax|TVA|MwSt|IVA|BTW", [("vat_eu", 0.1, r"\b[A-Z]{2}\s?\d{3}[\s]?\d{3,4}[\s]?\d{2,4}\b")]),
    ("UK_DRIVING_LICENCE", "driving licence|driver's licence|DVLA|driving license", [("uk_dl", 0.75, r"\b[A-Z]{5}\d{6}[A-Z0-9]{2}\d{2}[A-Z]{2}\b")]),
    ("DE_TAX_ID", "Steuer-ID|Steueridentifikationsnummer|tax identification|IdNr|TIN|German tax|Finanzamt", [("de_tax_id", 0.1, r"\b\d{11}\b")]),
    ("DE_SOCIAL_SECURITY", "Sozialversicherungsnummer|SV-Nummer|social security|Rentenversicherung|insurance number", [("de_sv", 0.6, r"\b\d{2}\s?\d{6}\s?[A-Z]\s?\d{2}\s?\d\b")]),
    ("FR_NIR", "NIR|INSEE|sécurité sociale|social security|numéro de sécurité|carte vitale", [("fr_nir", 0.65, r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b")]),
    ("FR_CNI", "carte nationale|CNI|national identity|carte d'identité|French ID|pièce d'identité", [("fr_cni", 0.1, r"\b\d{12}\b")]),
    ("IT_FISCAL_CODE", "codice fiscale|fiscal code|CF|Italian tax", [("it_cf", 0.8, r"\b[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]\b")]),
    ("IT_VAT", "partita IVA|VAT|P.IVA|Italian VAT", [("it_vat", 0.75, r"\bIT\s?\d{11}\b")]),
    ("ES_DNI", "DNI|documento nacional|national identity|NIF|Spanish ID|identidad", [("es_dni", 0.6, r"\b\d{8}[A-Z]\b")]),
    ("ES_NIE", "NIE|número de identidad de extranjero|foreigner|residency|Spanish residence", [("es_nie", 0.7, r"\b[XYZ]\d{7}[A-Z]\b")]),
    ("CY_TIC", "TIC|tax identification|Cyprus tax|φορολογικός|αριθμός φορολογικού|ΤΙΜ", [("cy_tic", 0.5, r"\b\d{8}[A-Z]\b")]),
    ("CY_ID_CARD", "Cyprus ID|identity card|ARC number|ταυτότητα|αριθμός ταυτότητας|Cypriot ID", [("cy_id", 0.05, r"\b\d{6,8}\b")]),
    (
        "EU_VAT",
        "VAT|TVA|Mehrwertsteuer|MwSt|IVA|BTW|tax number|VAT number|VAT ID|registration",
        [
            (f"vat_{name}", score, rf"\b{shape}\b")
            for name, score, shape in [
                ("at", 0.8, r"ATU\d{8}"),
                ("be", 0.8, r"BE[01]\d{9}"),
                ("bg", 0.8, r"BG\d{9,10}"),
                ("cy", 0.8, r"CY\d{8}[A-Z]"),
                ("cz", 0.8, r"CZ\d{8,10}"),
                ("de", 0.8, r"DE\d{9}"),
                ("dk", 0.8, r"DK\d{8}"),
                ("ee", 0.8, r"EE\d{9}"),
                ("es", 0.8, r"ES[A-Z0-9]\d{7}[A-Z0-9]"),
                ("fi", 0.8, r"FI\d{8}"),
                ("fr", 0.8, r"FR[A-Z0-9]{2}\d{9}"),
                ("el", 0.8, r"EL\d{9}"),
                ("hr", 0.8, r"HR\d{11}"),
                ("hu", 0.8, r"HU\d{8}"),
                ("ie", 0.8, r"IE\d[A-Z0-9+*]\d{5}[A-Z]"),
                ("it", 0.8, r"IT\d{11}"),
                ("lt", 0.8, r"LT\d{9,12}"),
                ("lu", 0.8, r"LU\d{8}"),
                ("lv", 0.8, r"LV\d{11}"),
                ("mt", 0.8, r"MT\d{8}"),
                ("nl", 0.8, r"NL\d{9}B\d{2}"),
                ("pl", 0.8, r"PL\d{10}"),
                ("pt", 0.8, r"PT\d{9}"),
                ("ro", 0.7, r"RO\d{2,10}"),
                ("se", 0.8, r"SE\d{12}"),
                ("si", 0.8, r"SI\d{8}"),
                ("sk", 0.8, r"SK\d{10}"),
                ("gb", 0.7, r"GB\d{9}"),
                ("ch", 0.8, r"CHE\d{9}"),
            ]
        ],
    ),
    (
        "EU_PASSPORT",
        "passport|travel document|passeport|Reisepass|pasaporte|passaporto|EU passport|European passport",
        [("eu_passport_2l7d", 0.3, r"\b[A-Z]{2}\d{7}\b"), ("eu_passport_1l8d", 0.3, r"\b[A-Z]\d{8}\b"), ("eu_passport_9d", 0.1, r"\b\d{9}\b")],
    ),
    ("ID_DOC", "CIN|corporate identity|identity number|registration|incorporated|Companies Act|company number", [("in_cin", 0.7, r"\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b")]),
    ("ID_DOC", "PAN|permanent account|income tax|tax|PAN number|PAN card", [("in_pan", 0.3, r"\b[A-Z]{5}\d{4}[A-Z]\b")]),
    ("ID_DOC", "GSTIN|GST|goods and services tax|tax registration", [("in_gstin", 0.75, r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][A-Z0-9]\b")]),
    (
        "ORGANIZATION",
        "company|corporation|entity|incorporated|registered|firm",
        [
            (
                "org_caps_suffix",
                0.4,
                rf"\b(?!(?:{'|'.join(CAPS_STOP)})\s)(?:(?:[A-Z][A-Z&.-]*|&)[\s,]+){{1,8}}"
                r"(?:LIMITED|PRIVATE\s+LIMITED|PVT\.?\s*LTD\.?|LTD\.?|LLP|INC\.?|CORP\.?|CORPORATION|GMBH|AG|AB|SA|NV|BV|PLC|LLC|CO\.)\b",
            ),
            ("org_mixed_suffix", 0.35, r"\b(?:(?:[A-Z][\w&.-]*|&)[\s,]+){1,8}(?:Limited|Ltd\.?|LLP|Inc\.?|Corp\.?|Corporation|GmbH|AG|AB|SA|NV|BV|PLC|LLC|Co\.)\b"),
            (
                "org_authority",
                0.4,
                r"\b[A-Z][a-zA-Z]+(?:\s+(?:of|the|and|for)\s+)?(?:\s+[A-Z][a-zA-Z]+){0,5}\s+"
                r"(?:Authority|Agency|Commission|Administration|Council|Bureau|Tribunal|Ministry|Directorate)\b",
            ),
        ],
    ),
]
# ---- end of fixed values ----

PATTERNS = [Pattern(kind, name, score, regex, tuple(context.split("|"))) for kind, context, shapes in RECOGNIZERS for name, score, regex in shapes]
BY_NAME = {p.name: p for p in PATTERNS}
KINDS = list(dict.fromkeys(p.kind for p in PATTERNS))

#: White space beyond ASCII that \\s stands for.
WIDE_SPACE = "\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
JAVA_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def spaced(regex: str) -> str:
    """\\s with all white space, in and outside of character classes."""
    out, inside, k = [], False, 0
    while k < len(regex):
        two = regex[k : k + 2]
        if two == "\\s":
            out.append(f"\\s{WIDE_SPACE}" if inside else f"[\\s{WIDE_SPACE}]")
        elif two == "\\S" and not inside:
            out.append(f"[^\\s{WIDE_SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[:1] == "[" or inside and two[:1] != "]"
            out.append(two[:1])
            k -= 1
        k += 2
    return "".join(out)


@cache
def python(regex: str, flags: int = 0) -> re.Pattern:
    return re.compile(spaced(regex), flags | re.ASCII)


def head(pattern: Pattern) -> str:
    """The letters and digits that every match of a pattern begins with."""
    if pattern.kind == "ORGANIZATION" or pattern.name == "email":
        return ""
    return re.match(r"(?:\\b)?((?:[A-Za-z0-9](?![?*+{|]))*)", pattern.regex)[1]


def java(pattern: Pattern) -> str:
    """The pattern for Spark. Where a boundary can only have a word character on its inner side, half of the look-around is enough.

    It is looked at behind the letters that a match begins with, so that most places of a text fail at their first letter."""
    regex = pattern.regex
    if pattern.kind != "ORGANIZATION":
        if regex.startswith(r"\b") and pattern.name != "email":
            first = head(pattern)
            regex = f"{first}(?<![A-Za-z0-9_]{first})" + regex[2 + len(first) :]
        if regex.endswith(r"\b"):
            regex = regex[:-2] + "(?![A-Za-z0-9_])"
    return regex.replace(r"\b", JAVA_BOUNDARY)
