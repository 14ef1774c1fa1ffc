"""The catalogue of data classes and the settings that choose among them."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from larkveil.plans import names

# --- Fixed values: classes, their order, priorities, policies, words and patterns ---

POLICIES = ("tokenize", "redact", "ignore")

CATEGORY_PRIORITY = {
    "SECRET": 220, "FINANCIAL": 210, "IDENTIFIER": 200, "HEALTH": 190, "CONTACT": 180, "NETWORK": 170, "URL": 160, "DOMAIN": 150,
    "PERSON": 140, "ORGANIZATION": 130, "LOCATION": 120, "BIRTH": 110, "ROLE": 100, "APPLICATION": 90, "KUBERNETES": 90,
    "DATABASE": 90, "TENANT": 90, "PROJECT": 90, "EDGE": 90, "REPOSITORY": 90, "TICKET": 90, "HTTP": 80,
}

#: Category, then its classes, in the order of registration.
CLASSES = {
    "PERSON": ["PERSON_FIRST_NAME", "PERSON_LAST_NAME", "PERSON_FULL_NAME", "PERSON_ALIAS", "PERSON_USERNAME", "PERSON_INITIALS"],
    "ROLE": ["SALUTATION", "TITLE", "ACADEMIC_TITLE", "JOB_TITLE", "DEPARTMENT", "EMPLOYER"],
    "ORGANIZATION": ["CUSTOMER_NAME", "ORGANIZATION_NAME", "PARTNER_NAME", "SUPPLIER_NAME"],
    "CONTACT": ["EMAIL", "PHONE", "MOBILE_PHONE", "FAX", "SIP_ADDRESS", "MESSENGER_ID", "SOCIAL_MEDIA_HANDLE"],
    "LOCATION": ["STREET", "HOUSE_NUMBER", "POSTAL_CODE", "CITY", "ADDRESS", "COUNTRY", "BUILDING", "ROOM", "GPS_COORDINATES"],
    "BIRTH": ["DATE_OF_BIRTH", "PLACE_OF_BIRTH"],
    "IDENTIFIER": [
        "EMPLOYEE_ID", "CUSTOMER_ID", "ACCOUNT_ID", "USER_ID", "CONTRACT_ID", "INSURANCE_ID", "TAX_ID", "SOCIAL_SECURITY_ID", "PASSPORT_ID", "NATIONAL_ID",
        "DRIVER_LICENSE_ID", "VEHICLE_REGISTRATION", "VIN", "GENERIC_ID",
    ],
    "FINANCIAL": [
        "IBAN", "BIC", "BANK_ACCOUNT", "CREDIT_CARD", "DEBIT_CARD", "CARDHOLDER", "CARD_EXPIRY", "CVV", "TRANSACTION_ID", "PAYMENT_REFERENCE", "INVOICE_ID",
    ],
    "HEALTH": ["HEALTH_INFORMATION", "MEDICAL_INFORMATION", "BIOMETRIC_INFORMATION", "GENETIC_INFORMATION"],
    "NETWORK": ["IP_ADDRESS", "PRIVATE_IP", "PUBLIC_IP", "MAC_ADDRESS"],
    "DOMAIN": ["DOMAIN", "CUSTOMER_DOMAIN", "INTERNAL_DOMAIN", "HOSTNAME", "FQDN"],
    "URL": ["URL", "INTERNAL_URL", "API_URL", "API_ENDPOINT", "API_PATH", "QUERY_PARAMETER", "QUERY_VALUE"],
    "APPLICATION": ["APPLICATION_NAME", "SERVICE_NAME", "MICROSERVICE_NAME"],
    "KUBERNETES": ["CLUSTER_NAME", "NAMESPACE", "POD_NAME", "CONTAINER_NAME"],
    "DATABASE": ["DATABASE_NAME", "DATABASE_HOST", "DATABASE_USER"],
    "TENANT": ["TENANT_NAME", "TENANT_ID", "ORGANIZATION_ID", "SUBSCRIPTION_ID"],
    "PROJECT": ["PROJECT_NAME", "ENVIRONMENT_NAME"],
    "EDGE": ["GATEWAY_NAME", "WAF_NAME", "LOAD_BALANCER_NAME"],
    "REPOSITORY": ["REPOSITORY_NAME", "BRANCH_NAME"],
    "TICKET": ["INCIDENT_ID", "FINDING_ID", "TICKET_ID", "CASE_ID"],
    "SECRET": [
        "API_KEY", "ANTHROPIC_API_KEY", "OPENAI_API_KEY", "STRIPE_SECRET_KEY", "API_SECRET", "CLIENT_SECRET", "PASSWORD", "PIN", "TAN", "OTP",
        "ACCESS_TOKEN", "REFRESH_TOKEN", "JWT", "OAUTH_CODE", "SESSION_ID", "SESSION_COOKIE", "AUTH_COOKIE", "CSRF_TOKEN", "PRIVATE_KEY", "SSH_PRIVATE_KEY",
        "TLS_PRIVATE_KEY", "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "AZURE_SECRET", "GCP_CREDENTIAL", "KUBERNETES_SECRET", "GITHUB_TOKEN", "GITLAB_TOKEN",
        "PERSONAL_ACCESS_TOKEN", "DATABASE_CONNECTION_STRING", "SIGNED_URL", "SAS_TOKEN",
    ],
    "HTTP": ["CUSTOM_HEADER", "HEADER_VALUE", "COOKIE", "COOKIE_VALUE"],
}

#: Priorities that differ from the category's.
OWN_PRIORITY = {"PRIVATE_IP": 171, "PUBLIC_IP": 171, "CUSTOMER_DOMAIN": 151, "INTERNAL_DOMAIN": 151, "GENERIC_ID": 79}
IGNORED = ("SALUTATION",)
REDACTED_CATEGORY = "SECRET"
PERSON_LABEL = "PERSON"

#: Words before a value: markers for classes without patterns, context for the others.
WORDS = {
    "JOB_TITLE": ["position", "job title", "rolle"],
    "DEPARTMENT": ["abteilung", "department"],
    "EMPLOYER": ["arbeitgeber", "employer"],
    "PHONE": ["tel", "telefon", "phone", "fon"],
    "MOBILE_PHONE": ["mobil", "mobile", "handy", "cell"],
    "FAX": ["fax"],
    "BUILDING": ["gebäude", "building"],
    "ROOM": ["raum", "room"],
    "DATE_OF_BIRTH": ["geboren", "geb.", "geburtsdatum", "dob", "born", "birthday"],
    "EMPLOYEE_ID": ["mitarbeiter-nr", "personalnummer", "employee id"],
    "CUSTOMER_ID": ["kundennummer", "customer id", "customer no", "kunden-nr"],
    "ACCOUNT_ID": ["account", "konto", "kontonummer", "acct"],
    "USER_ID": ["user id", "userid", "benutzer-id"],
    "CONTRACT_ID": ["vertrag", "vertragsnummer", "contract"],
    "INSURANCE_ID": ["versicherungsnummer", "policy no", "police"],
    "TAX_ID": ["steuer", "tax", "ust", "vat"],
    "SOCIAL_SECURITY_ID": ["sozialversicherung", "sv-nummer", "ssn", "social security"],
    "PASSPORT_ID": ["reisepass", "passport"],
    "NATIONAL_ID": ["personalausweis", "ausweisnummer", "national id"],
    "DRIVER_LICENSE_ID": ["führerschein", "driver license"],
    "VEHICLE_REGISTRATION": ["kennzeichen", "plate"],
    "VIN": ["vin", "fahrgestell"],
    "IBAN": ["iban"],
    "BIC": ["bic", "swift", "iban"],
    "BANK_ACCOUNT": ["kontonummer", "account number"],
    "CREDIT_CARD": ["card", "karte", "visa", "mastercard", "amex", "kreditkarte"],
    "CARD_EXPIRY": ["expiry", "gültig bis", "exp"],
    "CVV": ["cvv", "cvc", "prüfziffer"],
    "TRANSACTION_ID": ["transaktion", "transaction", "txn"],
    "PAYMENT_REFERENCE": ["verwendungszweck", "payment reference"],
    "INVOICE_ID": ["rechnung", "rechnungsnummer", "invoice"],
    "HOSTNAME": ["host", "hostname", "server", "node"],
    "APPLICATION_NAME": ["application", "app"],
    "SERVICE_NAME": ["service"],
    "MICROSERVICE_NAME": ["microservice"],
    "CLUSTER_NAME": ["cluster"],
    "NAMESPACE": ["namespace", "ns"],
    "POD_NAME": ["pod", "pod/"],
    "CONTAINER_NAME": ["container"],
    "DATABASE_NAME": ["database", "db name"],
    "DATABASE_HOST": ["db host", "database host"],
    "DATABASE_USER": ["db user", "database user"],
    "TENANT_NAME": ["tenant"],
    "TENANT_ID": ["tenant id", "mandant"],
    "ORGANIZATION_ID": ["org id", "organization id"],
    "SUBSCRIPTION_ID": ["subscription"],
    "PROJECT_NAME": ["project", "projekt"],
    "ENVIRONMENT_NAME": ["environment", "env", "umgebung"],
    "GATEWAY_NAME": ["gateway"],
    "WAF_NAME": ["waf"],
    "LOAD_BALANCER_NAME": ["load balancer", "lb"],
    "REPOSITORY_NAME": ["repo", "repository"],
    "BRANCH_NAME": ["branch"],
    "INCIDENT_ID": ["incident", "inc"],
    "FINDING_ID": ["finding"],
    "TICKET_ID": ["ticket", "ticket-id"],
    "CASE_ID": ["case", "fall", "aktenzeichen"],
    "AWS_SECRET_KEY": ["aws_secret", "secret_access_key"],
    "AZURE_SECRET": ["client_secret", "azure"],
    "PERSONAL_ACCESS_TOKEN": ["pat", "personal access token"],
}

#: Classes whose patterns count only with one of their words before.
WORD_NEEDED = [
    "PHONE", "MOBILE_PHONE", "FAX", "DATE_OF_BIRTH", "TAX_ID", "VEHICLE_REGISTRATION", "BIC", "CARD_EXPIRY", "CVV", "AWS_SECRET_KEY", "AZURE_SECRET",
]

VALIDATOR = {
    "PHONE": "phone", "MOBILE_PHONE": "phone", "FAX": "phone", "DATE_OF_BIRTH": "date", "TAX_ID": "tax_id", "SOCIAL_SECURITY_ID": "ssn",
    "VIN": "vin", "IBAN": "iban", "BIC": "bic", "CREDIT_CARD": "luhn", "IP_ADDRESS": "ip", "MAC_ADDRESS": "mac", "FQDN": "fqdn",
}

_DIAL = r"(?:\+\d{1,3}[ \-]?)?(?:\(?\d{2,5}\)?[ \-/]?)\d{3,}(?:[ \-]?\d{2,})+"
_PASSWORD = r"""(?i)\b(?:password|passwd|pwd|kennwort|passwort)["']?\s*[:=]\s*"""

#: A value is the first group where there is one.
PATTERNS = {
    "PHONE": [_DIAL],
    "MOBILE_PHONE": [_DIAL],
    "FAX": [_DIAL],
    "GPS_COORDINATES": [r"-?\d{1,2}\.\d{4,},\s*-?\d{1,3}\.\d{4,}"],
    "DATE_OF_BIRTH": [r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b"],
    "TAX_ID": [r"\b\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{3}\b", r"\b[A-Z]{2}[0-9A-Z]{8,12}\b"],
    "SOCIAL_SECURITY_ID": [r"\b\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}\b", r"\b\d{3}-\d{2}-\d{4}\b"],
    "VEHICLE_REGISTRATION": [r"\b[A-ZÄÖÜ]{1,3}[- ][A-Z]{1,2}[ ]?\d{1,4}[EH]?\b"],
    "VIN": [r"\b[A-HJ-NPR-Z0-9]{17}\b"],
    "GENERIC_ID": [r"\b[A-Z]{2,6}-\d{2,}(?:-[A-Z0-9]{2,})*\b"],
    "IBAN": [r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}[ ]?[A-Z0-9]{1,4}\b"],
    "BIC": [r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"],
    "CREDIT_CARD": [r"\b(?:\d[ -]?){13,19}\b"],
    "CARD_EXPIRY": [r"\b(?:0[1-9]|1[0-2])/(?:\d{2}|\d{4})\b"],
    "CVV": [r"\b\d{3,4}\b"],
    "IP_ADDRESS": [r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"],
    "MAC_ADDRESS": [r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"],
    "FQDN": [r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,}[A-Za-z]{2,}\b"],
    "API_KEY": [r"""(?i)\b(?:api[_-]?key|x-api-key)["']?\s*[:=]\s*["']?([A-Za-z0-9_\-]{16,})"""],
    "ANTHROPIC_API_KEY": [r"\bsk-ant-[A-Za-z0-9_\-]{40,}"],
    "OPENAI_API_KEY": [r"\bsk-(?!ant-)(?:proj-)?[A-Za-z0-9_\-]{20,}"],
    "STRIPE_SECRET_KEY": [r"\bsk_(?:live|test)_[A-Za-z0-9]{20,}"],
    "API_SECRET": [r"""(?i)\bapi[_-]?secret\s*[:=]\s*["']?([A-Za-z0-9_\-]{12,})"""],
    "CLIENT_SECRET": [r"""(?i)\bclient[_-]?secret\s*[:=]\s*["']?([A-Za-z0-9_\-~.]{12,})"""],
    "PASSWORD": [
        _PASSWORD + r'"([^"\n]{4,})"',
        _PASSWORD + r"'([^'\n]{4,})'",
        _PASSWORD + r"""(?!["'])(\S[^\n]{3,}?)\s*[.,;:)\]]*$""",
    ],
    "PIN": [r"(?i)\bpin\s*[:=]?\s*(\d{4,8})\b"],
    "TAN": [r"(?i)\btan\s*[:=]?\s*(\d{6,8})\b"],
    "OTP": [r"(?i)\b(?:otp|one-time code|einmalcode)\s*[:=]?\s*(\d{6,8})\b"],
    "ACCESS_TOKEN": [r"(?i)bearer\s+([A-Za-z0-9._\-]{16,})", r"""(?i)access[_-]?token\s*[:=]\s*["']?([A-Za-z0-9._\-]{16,})"""],
    "REFRESH_TOKEN": [r"""(?i)refresh[_-]?token\s*[:=]\s*["']?([A-Za-z0-9._\-]{16,})"""],
    "JWT": [r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"],
    "OAUTH_CODE": [r"(?i)[?&]code=([A-Za-z0-9._\-]{16,})"],
    "SESSION_ID": [r"""(?i)\b(?:session[_-]?id|sessionid|jsessionid|phpsessid)\s*[:=]\s*["']?([A-Za-z0-9._\-]{8,})"""],
    "CSRF_TOKEN": [r"""(?i)\b(?:csrf[_-]?token|x-csrf-token|_csrf)\s*[:=]\s*["']?([A-Za-z0-9._\-]{8,})"""],
    "AWS_ACCESS_KEY": [r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"],
    "AWS_SECRET_KEY": [r"\b[A-Za-z0-9/+=]{40}\b"],
    "AZURE_SECRET": [r"\b[A-Za-z0-9~._-]{34,40}\b"],
    "GCP_CREDENTIAL": [r'"private_key_id":\s*"[a-f0-9]{40}"', r"\bAIza[0-9A-Za-z_-]{35}\b"],
    "GITHUB_TOKEN": [r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", r"\bgithub_pat_[A-Za-z0-9_]{80,}\b"],
    "GITLAB_TOKEN": [r"\bglpat-[A-Za-z0-9_-]{20,}\b"],
    "PERSONAL_ACCESS_TOKEN": [r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"],
}

GENITIVE_CATEGORIES = ("PERSON", "ORGANIZATION")

#: Salutation and the gender it tells ("" for none).
SALUTATIONS = {
    "Frau": "female", "Herr": "male", "Herrn": "male", "Mrs": "female", "Mrs.": "female", "Ms": "female", "Ms.": "female",
    "Miss": "female", "Mr": "male", "Mr.": "male", "Mx": "", "Mx.": "", "Dr": "", "Dr.": "", "Prof": "", "Prof.": "",
}

COUNTRIES = [
    "Deutschland", "Germany", "Österreich", "Austria", "Schweiz", "Switzerland", "Frankreich", "France", "Italien", "Italy", "Spanien", "Spain",
    "Portugal", "Niederlande", "Netherlands", "Belgien", "Belgium", "Luxemburg", "Luxembourg", "Dänemark", "Denmark", "Schweden", "Sweden", "Norwegen",
    "Norway", "Finnland", "Finland", "Iceland", "Irland", "Ireland", "Vereinigtes Königreich", "United Kingdom", "Großbritannien", "Great Britain",
    "England", "Schottland", "Scotland", "Wales", "Polen", "Poland", "Tschechien", "Czech Republic", "Slowakei", "Slovakia", "Ungarn", "Hungary",
    "Slowenien", "Slovenia", "Kroatien", "Croatia", "Serbien", "Serbia", "Rumänien", "Romania", "Bulgarien", "Bulgaria", "Griechenland", "Greece",
    "Türkei", "Russland", "Ukraine", "Estland", "Estonia", "Lettland", "Latvia", "Litauen", "Lithuania", "Vereinigte Staaten", "United States", "Kanada",
    "Canada", "Mexiko", "Mexico", "Brasilien", "Brazil", "Argentinien", "Argentina", "Australien", "Australia", "Neuseeland", "New Zealand", "Japan",
    "Indien", "India", "Südkorea", "South Korea", "Singapur", "Singapore", "Israel", "Ägypten", "Egypt", "Südafrika", "South Africa", "Marokko",
    "Morocco", "Nigeria", "Kenia", "Kenya",
]

MEDICAL_TERMS = [
    "Diabetes", "Diabetes mellitus", "Hypertonie", "Hypertension", "Asthma", "Asthma bronchiale", "COPD", "Bronchitis", "Pneumonie", "Migräne",
    "Migraine", "Epilepsie", "Epilepsy", "Depression", "Angststörung", "Burnout", "Demenz", "Alzheimer", "Parkinson", "Multiple Sklerose", "Rheuma",
    "Arthrose", "Arthritis", "Osteoporose", "Gicht", "Bandscheibenvorfall", "Skoliose", "Herzinsuffizienz", "Herzinfarkt", "Myokardinfarkt",
    "Angina pectoris", "Vorhofflimmern", "Arrhythmie", "Schlaganfall", "Thrombose", "Embolie", "Lungenembolie", "Anämie", "Leukämie", "Lymphom",
    "Karzinom", "Mammakarzinom", "Prostatakarzinom", "Kolonkarzinom", "Melanom", "Metastase", "Chemotherapie", "Strahlentherapie", "Dialyse",
    "Niereninsuffizienz", "Nierensteine", "Zystitis", "Hepatitis", "Leberzirrhose", "Gastritis", "Reflux", "Magengeschwür", "Zöliakie", "Morbus Crohn",
    "Colitis ulcerosa", "Reizdarmsyndrom", "Divertikulitis", "Pankreatitis", "Gallensteine", "Schilddrüsenunterfunktion", "Hypothyreose",
    "Hyperthyreose", "Hashimoto", "Morbus Basedow", "Adipositas", "Hypercholesterinämie", "Allergie", "Heuschnupfen", "Neurodermitis", "Psoriasis",
    "Ekzem", "Urtikaria", "Rosazea", "Influenza", "Tuberkulose", "Borreliose", "Sepsis", "Meningitis", "Otitis", "Sinusitis", "Tonsillitis",
    "Konjunktivitis", "Katarakt", "Glaukom", "Makuladegeneration", "Tinnitus", "Hörsturz", "Vertigo", "Fibromyalgie", "Schlafapnoe", "Insomnie",
    "Schizophrenie", "Bipolare Störung", "Autismus", "Anorexie", "Bulimie", "Alkoholabhängigkeit", "Metformin", "Insulin", "Ibuprofen", "Paracetamol",
    "Aspirin", "Acetylsalicylsäure", "Diclofenac", "Naproxen", "Metamizol", "Tramadol", "Morphin", "Fentanyl", "Cortison", "Prednisolon", "Ramipril",
    "Enalapril", "Candesartan", "Valsartan", "Bisoprolol", "Metoprolol", "Amlodipin", "Simvastatin", "Atorvastatin", "Phenprocoumon", "Apixaban",
    "Rivaroxaban", "Clopidogrel", "Pantoprazol", "Omeprazol", "Levothyroxin", "Citalopram", "Sertralin", "Escitalopram", "Venlafaxin", "Mirtazapin",
    "Quetiapin", "Lorazepam", "Diazepam", "Zolpidem", "Amoxicillin", "Penicillin", "Azithromycin", "Ciprofloxacin", "Doxycyclin", "Cefuroxim",
    "Salbutamol", "Budesonid", "Formoterol", "Tiotropium", "Cetirizin", "Loratadin", "Methotrexat", "Adalimumab", "Tamoxifen", "E11.9", "I10", "J45.9",
    "F32.1", "M54.5", "E66.9", "K21.0", "I25.9", "G43.0", "E03.9", "N18.3", "C50.9", "F41.1", "J44.9", "I48.0", "E78.5", "M17.1", "L40.0", "K51.9",
    "G35",
]

#: Lists of known words: class, confidence.
WORD_LISTS = {"PERSON_FIRST_NAME": 0.3, "PERSON_LAST_NAME": 0.3, "CITY": 0.3, "MEDICAL_INFORMATION": 0.8}

# --- End of fixed values ---


class SettingsError(ValueError):
    """Settings that can't be used."""


@dataclass(frozen=True)
class DataClass:
    name: str
    category: str
    policy: str = "tokenize"
    priority: int = 0
    enabled: bool = True
    label: str = ""
    patterns: tuple[str, ...] = ()
    validator: str | None = None
    words: tuple[str, ...] = ()
    word_needed: bool = False

    @property
    def genitive(self) -> bool:
        return self.category in GENITIVE_CATEGORIES


def default_classes() -> dict[str, DataClass]:
    out = {}
    for category, names in CLASSES.items():
        for name in names:
            policy = "redact" if category == REDACTED_CATEGORY else "ignore" if name in IGNORED else "tokenize"
            label = PERSON_LABEL if name.startswith(PERSON_LABEL + "_") else name
            out[name] = DataClass(
                name, category, policy, OWN_PRIORITY.get(name, CATEGORY_PRIORITY[category]), True, label,
                tuple(PATTERNS.get(name, ())), VALIDATOR.get(name), tuple(WORDS.get(name, ())), name in WORD_NEEDED,
            )
    return out


def default_words() -> dict[str, tuple[str, ...]]:
    """Lists of known words where the settings name no files."""
    return {"PERSON_FIRST_NAME": tuple(names.FIRST_NAMES), "PERSON_LAST_NAME": tuple(names.LAST_NAMES), "CITY": tuple(names.CITIES), "MEDICAL_INFORMATION": tuple(MEDICAL_TERMS)}


@dataclass(frozen=True)
class Settings:
    """Everything that decides what is found and what becomes of it; picklable, so kernels carry it."""

    classes: dict[str, DataClass] = field(default_factory=default_classes)
    dictionaries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    word_lists: dict[str, tuple[str, ...]] = field(default_factory=default_words)
    restore_mode: str = "strict"
    gender_from_salutation: bool = True
    languages: tuple[str, ...] = ("de", "en")
    min_confidence: float = 0.5
    audit_path: str | None = None
    vault_path: str | None = None
    key_path: str | None = None

    def enabled(self) -> list[DataClass]:
        return [c for c in self.classes.values() if c.enabled]

    def is_on(self, name: str) -> bool:
        return name in self.classes and self.classes[name].enabled

    def fingerprint(self) -> str:
        """A hash of all of it, the same for equal settings whatever their order."""
        plain = {
            "classes": {n: vars(c) for n, c in self.classes.items()},
            "dictionaries": {k: sorted(v) for k, v in self.dictionaries.items()},
            "word_lists": {k: sorted(v) for k, v in self.word_lists.items()},
            "rest": [self.restore_mode, self.gender_from_salutation, list(self.languages), self.min_confidence],
        }
        return hashlib.sha256(json.dumps(plain, sort_keys=True, default=list).encode()).hexdigest()


_SECTIONS = {"classes", "dictionaries", "word_lists", "restore", "person", "languages", "min_confidence", "audit", "vault"}
_CLASS_KEYS = {"category": "category", "policy": "policy", "priority": "priority", "enabled": "enabled", "token_label": "label", "patterns": "patterns", "validator": "validator", "context_words": "words", "context_required": "word_needed"}
VALIDATOR_NAMES = ("luhn", "iban", "bic", "ip", "mac", "vin", "phone", "date", "tax_id", "ssn", "fqdn")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SettingsError(message)


def _known(given: dict, allowed: set[str], where: str) -> None:
    extra = sorted(set(given) - allowed)
    _need(not extra, f"unknown keys in {where}: {', '.join(extra)}")


def _strings(value: object, where: str) -> tuple[str, ...]:
    _need(isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value), f"{where} must be a list of strings")
    return tuple(value)


def with_class(settings: Settings, name: str, given: dict) -> Settings:
    """Settings with a class added, or with some of its keys set anew."""
    _known(given, set(_CLASS_KEYS), f"class {name}")
    old = settings.classes.get(name)
    category = given.get("category", old.category if old else None)
    _need(category in CATEGORY_PRIORITY, f"class {name}: unknown category {category!r}")
    if old is None:
        old = DataClass(name, category, priority=CATEGORY_PRIORITY[category], label=PERSON_LABEL if name.startswith("PERSON_") else name)
    elif category != old.category and "priority" not in given and old.priority == CATEGORY_PRIORITY[old.category]:
        old = replace(old, priority=CATEGORY_PRIORITY[category])
    new = {_CLASS_KEYS[k]: v for k, v in given.items()}
    for key in ("patterns", "words"):
        if key in new:
            new[key] = _strings(new[key], f"class {name}: {key}")
    _need(new.get("policy", old.policy) in POLICIES, f"class {name}: unknown policy")
    _need(isinstance(new.get("priority", 0), int) and not isinstance(new.get("priority", 0), bool), f"class {name}: priority must be a whole number")
    for key in ("enabled", "word_needed"):
        _need(isinstance(new.get(key, True), bool), f"class {name}: {key} must be true or false")
    _need(new.get("validator") in (None, *VALIDATOR_NAMES), f"class {name}: unknown validator")
    for pattern in new.get("patterns", ()):
        try:
            re.compile(pattern, re.MULTILINE)
        except re.error as e:
            raise SettingsError(f"class {name}: {e}") from e
    return replace(settings, classes=settings.classes | {name: replace(old, **new)})


#: Variables that stand over all files.
ENVIRONMENT = {"LARKVEIL_VAULT": "vault_path", "LARKVEIL_KEY_FILE": "key_path", "LARKVEIL_AUDIT": "audit_path", "LARKVEIL_RESTORE_MODE": "restore_mode"}


def layered(*layers: dict, env: dict[str, str] | None = None) -> Settings:
    """Defaults, then each layer: class keys overwrite, dictionaries append what is new, the rest replaces."""
    out = Settings()
    for layer in layers:
        _known(layer, _SECTIONS, "settings")
        for name, given in (layer.get("classes") or {}).items():
            out = with_class(out, name, given or {})
        for key, target in (("dictionaries", out.dictionaries), ("word_lists", out.word_lists)):
            for name, terms in (layer.get(key) or {}).items():
                _need(name in out.classes, f"{key}: unknown class {name}")
                target = target | {name: tuple(dict.fromkeys([*target.get(name, ()), *_strings(terms, f"{key}.{name}")]))}
            out = replace(out, **{key: target})
        if "restore" in layer:
            _known(layer["restore"], {"mode"}, "restore")
            out = replace(out, restore_mode=layer["restore"].get("mode", out.restore_mode))
        if "person" in layer:
            _known(layer["person"], {"record_gender_from_salutation"}, "person")
            flag = layer["person"].get("record_gender_from_salutation", True)
            _need(isinstance(flag, bool), "person: record_gender_from_salutation must be true or false")
            out = replace(out, gender_from_salutation=flag)
        if "audit" in layer:
            _known(layer["audit"], {"path"}, "audit")
            path = layer["audit"].get("path")
            _need(path is None or (isinstance(path, str) and path.strip() != ""), "audit: path must not be blank")
            out = replace(out, audit_path=path)
        if "languages" in layer:
            out = replace(out, languages=_strings(layer["languages"], "languages"))
        if "min_confidence" in layer:
            least = layer["min_confidence"]
            _need(isinstance(least, (int, float)) and not isinstance(least, bool) and 0 <= least <= 1, "min_confidence must lie in 0..1")
            out = replace(out, min_confidence=float(least))
        if "vault" in layer:
            _known(layer["vault"], {"path", "key_file"}, "vault")
            for name, value in layer["vault"].items():
                _need(isinstance(value, str) and value.strip() != "", f"vault: {name} must not be blank")
            out = replace(out, vault_path=layer["vault"].get("path", out.vault_path), key_path=layer["vault"].get("key_file", out.key_path))
    out = replace(out, **{name: env[variable] for variable, name in ENVIRONMENT.items() if env and env.get(variable)})
    _need(out.restore_mode in ("strict", "lenient"), "restore: mode must be strict or lenient")
    return out
