"""Fixed values that must equal the behaviour being reproduced.

Everything here is data, not logic: word lists, name patterns, synonym tables,
labels and thresholds. They are stated once, in natural order, so that every
module reads the same values.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — must stay identical for results to match
# ---------------------------------------------------------------------------

# Cell texts that mean "missing" (compared after trimming, case-insensitive).
MISSING_MARKERS = ["", "nan", "none", "null", "n/a", "na", "-", "--"]

# Boolean words (compared after trimming, case-insensitive).
TRUE_WORDS = ["true", "yes", "y", "1", "oui", "vrai"]
FALSE_WORDS = ["false", "no", "n", "0", "non", "faux"]

# Gender synonyms used by category normalisation.
MALE_WORDS = ["m", "male", "man", "masculin", "homme"]
FEMALE_WORDS = ["f", "female", "woman", "feminin", "feminine", "femme"]

# Currency symbols and ISO codes removed before number parsing.
CURRENCY_SYMBOLS = "$€£¥₦"
CURRENCY_CODES = ["usd", "eur", "gbp", "ngn", "xaf", "xof"]

# Column-name patterns (Python/Java regex syntax, applied to lower-case names).
IDENTIFIER_NAME_PATTERN = r"(^|_|\b)(id|code|ref|reference|matricule|uuid|key|no|number)(_|$|\b)"
DATE_NAME_PATTERN = (
    r"(^|_|\b)(date|start|end|joining|joined|created|updated|period|month|year|time)(_|$|\b)"
)
MEASURE_NAME_PATTERN = (
    r"(amount|salary|total|price|cost|quantity|qty|revenue|sales|balance|budget|fee|payment|debit|credit|rate|score)"
)
CURRENCY_VALUE_PATTERN = r"(?i)[$€£¥₦]|usd|eur|gbp|ngn|xaf|xof"

# A cell "looks numeric" for the cleaning step when it matches this pattern.
LOOKS_NUMERIC_PATTERN = r"^\s*-?\(?\s*[$€£¥₦]?\s*[\d\s.,\xa0]+%?\)?\s*$"

# A value "looks like a date" when it contains one of these.
DATE_LIKE_VALUE_PATTERN = r"(?i)[-/]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

# Name keywords that make the cleaning step try date parsing (substring test).
CLEAN_DATE_KEYWORDS = ["date", "start", "end", "joining", "joined", "created", "updated"]

# Names that are person/customer names: role becomes Attribute when unique enough.
PERSON_NAME_COLUMNS = ["name", "full_name", "employee_name", "customer_name"]

# Header synonyms -> preferred snake_case name (key: accent-free lower-case words).
RENAME_HINTS = {
    "no": "employee_id",
    "n_": "employee_id",
    "matricule": "employee_id",
    "id": "employee_id",
    "name": "employee_name",
    "full name": "employee_name",
    "nom": "employee_name",
    "nom complet": "employee_name",
    "gender": "gender",
    "genre": "gender",
    "sex": "gender",
    "department": "department",
    "dept": "department",
    "departement": "department",
    "service": "department",
    "start date": "start_date",
    "joining date": "start_date",
    "date debut": "start_date",
    "date d embauche": "start_date",
    "hire date": "start_date",
    "end date": "end_date",
    "monthly salary": "monthly_salary",
    "salary monthly": "monthly_salary",
    "salaire mensuel": "monthly_salary",
    "annual salary": "annual_salary",
    "salaire annuel": "annual_salary",
    "dob": "date_of_birth",
    "date of birth": "date_of_birth",
    "date naissance": "date_of_birth",
    "email": "email",
    "phone": "phone",
    "telephone": "phone",
    "address": "address",
    "adresse": "address",
}

# Display labels for well-known column names.
COLUMN_LABELS = {
    "employee_id": "Identifiant employé",
    "employee_name": "Nom de l'employé",
    "gender": "Genre",
    "department": "Département",
    "start_date": "Date de début",
    "end_date": "Date de fin",
    "monthly_salary": "Salaire mensuel",
    "annual_salary": "Salaire annuel",
    "date_of_birth": "Date de naissance",
    "email": "Adresse e-mail",
    "phone": "Téléphone",
    "address": "Adresse",
    "country": "Pays",
    "city": "Ville",
    "amount": "Montant",
    "total": "Total",
    "quantity": "Quantité",
    "price": "Prix",
    "cost": "Coût",
    "revenue": "Chiffre d'affaires",
    "customer": "Client",
    "product": "Produit",
}

# Lower-case roles (modern path) for the capitalised roles (legacy path).
ROLE_TO_SEMANTIC = {
    "Identifier": "identifier",
    "Measure": "measure",
    "Dimension": "dimension",
    "Date Dimension": "date",
    "Attribute": "attribute",
    "Ignored": "unknown",
}

# Aggregations allowed in dashboard widgets.
WIDGET_AGGREGATIONS = ["sum", "avg", "min", "max", "count"]

# Calculation names of the interactive (SQL-style) charts.
CALCULATIONS = {
    "Total": "sum",
    "Moyenne": "avg",
    "Minimum": "min",
    "Maximum": "max",
    "Nombre": "count",
    "Nombre unique": "count_distinct",
}

# Widget types of a dashboard spec; duplicate-signature priority (higher wins).
WIDGET_TYPES = ["kpi_card", "bar_chart", "line_chart", "pie_chart", "data_table", "filter"]
WIDGET_PRIORITY = {"line_chart": 4, "bar_chart": 3, "kpi_card": 3, "pie_chart": 1}

# Safe-measure test: a measure whose name/label contains one of these is skipped.
UNSAFE_MEASURE_TOKENS = [" id", "_id", "code", "matricule", " ref", "reference", "date", "start", "end", "joining", "created"]

# Thresholds.
LAYOUT_COLUMNS = 12
DEFAULT_TOP_N = 25          # modern bar / pie charts
DEFAULT_SQL_TOP_N = 10      # interactive charts
FILTER_VALUES_LIMIT = 100
TABLE_ROWS_LIMIT = 100
SCATTER_POINTS_LIMIT = 500
PREVIEW_ROWS = 50
CATEGORY_DIMENSION_MAX_DISTINCT = 100
DIMENSION_VALUE_MAX_CHARS = 255
NAME_MAX_CHARS = 54

# Legality of calculations (I8): what each needs; roles guessed from names where none is stored.
MEASURE_CALCULATIONS = ["Total", "Moyenne", "Minimum", "Maximum"]
ADDING_CALCULATIONS = ["Total", "Moyenne"]
COUNTING_CALCULATIONS = ["Nombre", "Nombre unique"]
DATE_ROLE_TOKENS = ["date", "start", "end", "joining", "created"]
IDENTIFIER_ROLE_TOKENS = [" id", "_id", "code", "matricule", " ref"]
