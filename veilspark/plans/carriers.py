"""Texts that hold personal data of every type, built from the keys of the star tables by one SQL
expression that Spark and DuckDB read alike."""

from __future__ import annotations

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def up(k: str) -> str:
    """A capital letter of a number."""
    return f"substr({UPPER}, 1 + cast(({k}) % 26 as int), 1)"


def num(k: str, size: int) -> str:
    """`size` digits of a number."""
    return f"lpad(cast({k} as string), {size}, '0')"


def cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


K = "c_custkey"
D4 = num(f"{K} % 10000", 4)

#: A value of each type in terms of a key, and a phrase that holds one of its context words.
VALUES = {
    "EMAIL_ADDRESS": (cat("'user.'", f"cast({K} as string)", "'@host'", f"cast({K} % 9 as string)", "'.example.org'"), "'write by email to '"),
    "PHONE_NUMBER": (cat("'+'", f"cast(1 + {K} % 90 as string)", "' '", num(f"100 + {K} % 900", 3), "' '", D4, "' '", D4), "'telephone '"),
    "URL": (cat("'https://shop'", f"cast({K} as string)", "'.example.net/p?q='", f"cast({K} % 17 as string)"), "'see our website '"),
    "IP_ADDRESS": (cat("'10'", f"cast({K} % 10 as string)", "'.'", f"cast({K} % 256 as string)", "'.'", f"cast({K} * 7 % 256 as string)", "'.'", f"cast({K} * 3 % 256 as string)"), "'the server at '"),
    "CREDIT_CARD": (cat(f"case {K} % 3 when 0 then '4' when 1 then '52' else '37' end", f"case {K} % 3 when 0 then '111' when 1 then '22' else '11' end", "'-'", f"case {K} % 3 when 2 then '22' else '' end", D4, f"case {K} % 3 when 2 then '' else '-' end", f"case {K} % 3 when 2 then '-' else '' end", D4, f"case {K} % 3 when 2 then '7' else '-' end", f"case {K} % 3 when 2 then '' else {D4} end"), "'card number '"),
    "IBAN_CODE": (cat("'DE'", num(f"{K} % 100", 2), "' '", D4, "' 5678 '", D4, "' 12'"), "'bank account '"),
    "CRYPTO": (cat("'0x'", num(f"{K}", 20), num(f"{K} * 31", 20)), "'wallet '"),
    "US_SSN": (cat(num(f"{K} % 1000", 3), "'-'", num(f"{K} % 100", 2), "'-'", D4), "'social security '"),
    "US_PASSPORT": (cat(up(K), num(f"{K}", 8)), "'State Department passport '"),
    "US_DRIVER_LICENSE": (cat(up(K), num(f"{K}", 9)), "'DMV driver license '"),
    "UK_NHS": (cat(num(f"{K} % 1000", 3), "' '", num(f"{K} * 7 % 1000", 3), "' '", D4), "'patient number '"),
    "UK_NIN": (cat("'AB '", num(f"{K} % 100", 2), "' '", num(f"{K} * 3 % 100", 2), "' '", num(f"{K} * 7 % 100", 2), "' C'"), "'national insurance '"),
    "UK_PASSPORT": (num(f"{K} + 100000000", 9), "'HM Passport '"),
    "UK_CRN": (cat("'SC'", num(f"{K} % 1000000", 6)), "'Companies House '"),
    "ID_DOC": (cat("'HRB '", num(f"{K} + 10000", 6)), "'registration number '"),
    "UK_DRIVING_LICENCE": (cat("'MORGA'", num(f"{K}", 6), "'AB'", num(f"{K} % 100", 2), "'XY'"), "'DVLA '"),
    "DE_TAX_ID": (num(f"{K} + 10000000000", 11), "'Steuer-ID '"),
    "DE_SOCIAL_SECURITY": (cat(num(f"{K} % 100", 2), "' '", num(f"{K}", 6), "' M '", num(f"{K} % 100", 2), "' 7'"), "'Rentenversicherung '"),
    "FR_NIR": (cat("'1 '", num(f"{K} % 100", 2), "' 05 75 '", num(f"{K} % 1000", 3), "' '", num(f"{K} * 3 % 1000", 3), "' 42'"), "'carte vitale '"),
    "FR_CNI": (num(f"{K} + 100000000000", 12), "'carte nationale '"),
    "IT_FISCAL_CODE": (cat("'RSSMRA'", num(f"{K} % 100", 2), "'B'", num(f"{K} * 3 % 100", 2), "'H'", num(f"{K} % 1000", 3), up(K)), "'codice fiscale '"),
    "IT_VAT": (cat("'IT '", num(f"{K}", 11)), "'partita IVA '"),
    "ES_DNI": (cat(num(f"{K} + 10000000", 8), up(K)), "'documento nacional '"),
    "ES_NIE": (cat("'X'", num(f"{K}", 7), up(K)), "'foreigner '"),
    "CY_TIC": (cat(num(f"{K} + 20000000", 8), up(K)), "'Cyprus tax '"),
    "CY_ID_CARD": (num(f"{K} + 1000000", 7), "'Cyprus ID '"),
    "EU_VAT": (cat(f"case {K} % 4 when 0 then 'DE' when 1 then 'EL' when 2 then 'PT' else 'GB' end", num(f"{K}", 9)), "'VAT ID '"),
    "EU_PASSPORT": (cat("'XK'", num(f"{K}", 7)), "'Reisepass '"),
    "ORGANIZATION": (cat("'Norvex'", f"cast({K} as string)", "' Holdings '", f"case {K} % 3 when 0 then 'Ltd' when 1 then 'GmbH' else 'Corporation' end"), "'the firm '"),
}


def text_of(kind: str) -> str:
    """A sentence with a value of the type; two of three rows have context."""
    value, context = VALUES[kind]
    return cat("'row '", f"case {K} % 3 when 0 then 'xx ' else {context} end", value, "' ok'", f"case {K} % 5 when 0 then {cat(chr(39) + ' zz ' + chr(39), value)} else '' end")
