"""Word lists, patterns and labels that results depend on.

They are stated as data so that callers can read or replace them; no logic lives here.
"""

# --- name suffixes -----------------------------------------------------------------------------

# fixed values: tokens removed anywhere in a name by norm_name
NAME_NOISE_TOKENS = (
    r"jr\.?", r"sr\.?", "ii", "iii", "iv", "v", "md", "do", "np", "pa", "rn", "lpn", "crnp", "cnm", "aprn",
)

# fixed values: one trailing credential or generation suffix
TRAILING_SUFFIXES = (
    "jr", "sr", "ii", "iii", "iv", "md", "do", "dpm", "dds", "phd", "np", "pa", "rn", "aprn", "cnp", "cnm", "cns",
    "esq",
)
TRAILING_SUFFIXES_LONG = TRAILING_SUFFIXES + ("fnp", "crna", "crnp")

# --- addresses ---------------------------------------------------------------------------------

# fixed values: street words and their abbreviations
STREET_WORDS = {
    "street": "st",
    "avenue": "ave",
    "boulevard": "blvd",
    "drive": "dr",
    "road": "rd",
    "lane": "ln",
    "court": "ct",
    "circle": "cir",
    "place": "pl",
}
PARKWAY_WORDS = {"parkway": "pkwy", "highway": "hwy"}
EXPRESSWAY_WORDS = {"expressway": "expy"}
SUITE_WORDS = {"suite": "ste"}
BUILDING_WORDS = {"floor": "fl", "building": "bldg"}
CARDINAL_WORDS = {"north": "n", "south": "s", "east": "e", "west": "w"}
INTERCARDINAL_WORDS = {"northwest": "nw", "northeast": "ne", "southwest": "sw", "southeast": "se"}

# fixed values: ordinal words
ORDINAL_WORDS = {
    "first": "1st",
    "second": "2nd",
    "third": "3rd",
    "fourth": "4th",
    "fifth": "5th",
    "sixth": "6th",
    "seventh": "7th",
    "eighth": "8th",
    "ninth": "9th",
    "tenth": "10th",
    "eleventh": "11th",
    "twelfth": "12th",
}

# fixed values: city words
CITY_WORDS = {"saint": "st", "fort": "ft", "mount": "mt"}

# fixed values: a house number followed by a direction and the rest of the street
PRE_DIRECTION = r"^(\d+\w*)\s+(n|s|e|w|ne|nw|se|sw)\s+(.+)$"

# fixed values: a suite, floor or unit tail inside an address line
UNIT_TAIL = r"\b(suite|ste|floor|fl\b|room|rm\b|apt|unit\b|bldg|#)\s*[\w-]+"

# fixed values: a unit word on the second address line
UNIT_MARK = r"\b(suite|ste|floor|fl\b|room|rm\b|apt|unit\b|#)\b"

# fixed values: post-office boxes
PO_BOX = r"^\s*p\.?\s*o\.?\s*box\b"

# fixed values: department lines that push the street to line two
DEPARTMENT_LINE = r"^(department of|division of|dept\.? of)\b"

# --- labels ------------------------------------------------------------------------------------

# fixed values: texts that are never an organisation name
NOT_A_LABEL = (
    r"(nan|none|n/?a|home)\s*$",
    r"(suite|ste|floor|fl\b|room|rm\b|apt|unit\b|bldg|building|"
    r"c/o|attention|attn|united states postal|usps|post office)\b",
)
NOT_A_LABEL_MORE = (
    r"(mmc|mail route|mail stop|vcrc)\b",
    r"mr#\s*\d+",
    r"\bmail\s+(delivery\s+)?code\b",
    r"(department of|division of|dept\.? of)\b",
    r",\s*(department of|division of)\b",
    r"\*{3,}",
    r"at\s+\w",
)

# fixed values: labels that read like one person
ONE_PERSON = (
    r"^dr\.?\s",
    r",\s*(md|do|dpm|dds|np|rn|aprn|cnp|cnm|cns|phd|dnp|facc|fhrs|mbbs|msph)[\s,]*$",
    r"\s[-–]\s*(md|do|np|rn|aprn)\s*$",
    r"\b(md|do|dnp|facc|fhrs)\s*$",
)

# fixed values: practice labels
SOLO = "Solo Practice"
GROUP = "Group Practice"
SOLO_WORDS = ("solo practice", "solo")
GROUP_WORDS = ("group practice", "group")

# fixed values: place names
REAL_ESTATE_LABEL = "REAL_ESTATE"
MEDICAL_WORDS = (
    "clinic|hospital|medical|health|care|wellness|rehab|therapy|therapist|"
    "surgery|surgical|ortho|cardio|oncol|pediatr|neuro|psych|mental|dental|"
    "vision|eye|family practice|urgent care|emergency|pharmacy|pharma|"
    "clinica|salud|centro|community|associates|group|practice|services|urgent"
)
REAL_ESTATE_WORDS = (
    "airbnb|vrbo|zillow|trulia|redfin|realtor|keller williams|coldwell|"
    "century 21|re/max|remax|sotheby|real estate|realty|properties|"
    "apartments|apartment|condo|rental|rentals|suites|inn|hotel|motel|"
    "lodge|resort|vacation"
)
MEDICAL_TYPES = (
    "hospital", "doctor", "pharmacy", "health", "dentist", "physiotherapist", "medical_lab", "drugstore", "university",
)

# --- credentials -------------------------------------------------------------------------------

# fixed values: credential categories in the order they are tried
CREDENTIAL_PATTERNS = (
    ("physician", r"\bm\.?d\.?\b|\bd\.?o\.?\b|medical\s+doctor|physician\s+and\s+surgeon|"
                  r"doctor\s+of\s+(medicine|osteo)"),
    ("pa", r"\bpa[-\s]?c?\b|physician\s+assistant"),
    ("cnm", r"\bcnm\b|\bnm\b|nurse\s+midwife"),
    ("cns", r"\bcns\b|clinical\s+nurse\s+specialist"),
    ("np", r"\bcnp\b|\bfnp\b|\banp\b|\bpnp\b|\bgnp\b|\bacnp\b|\baprn\b|\bnp[-\s]?c?\b"),
    ("crna", r"\bcrna\b|nurse\s+anesthetist"),
    ("rn", r"\brn\b|registered\s+nurse"),
)

# fixed values: display titles
TITLES = {"physician": "Dr", "pa": "PA", "np": "NP", "cnm": "CNM", "cns": "CNS", "crna": "CRNA", "rn": "RN"}

# fixed values: credential columns in the order they are read
CREDENTIAL_COLUMNS = ("credential", "degree", "license_type_desc", "license_type")

# --- column names ------------------------------------------------------------------------------

# fixed values: synonyms for the roles of an external roster
ROSTER_ROLES = {
    "last": ["last name", "lastname", "last_name", "lname", "surname"],
    "first": ["first name", "firstname", "first_name", "fname", "given name"],
    "zip": ["zip", "zip5", "zip code", "postal code", "postalcode", "postal_code"],
    "city": ["city", "primary_city", "location city"],
}

# fixed values: synonyms for the roles of a ZIP crosswalk
CROSSWALK_ROLES = {
    "zip": ["zip_code", "zip", "zipcode", "zip5", "zcta", "zcta5"],
    "county": ["county_name", "county", "cnty_name", "cnty", "co_name", "countyname"],
    "fips": ["stcou", "county_fips", "fips", "co_fips", "fips_code", "countyfips", "geoid"],
}

# fixed values: address column sets as (address, city, zip, state) candidates
GOLD_ADDRESS_SETS = (
    (["_addr1"], ["_city"], ["_zip"], ["_state", "primary_state", "state"]),
    (["_mail_addr"], ["_mail_city"], ["_mail_zip"], ["_mail_state", "mailing_state"]),
)
RAW_ADDRESS_SETS = (
    (
        ["npi_primary_address_1", "primary_address_1", "Delivery Address", "address_line1", "Alternate 1 Address"],
        ["npi_primary_city", "primary_city", "City", "city"],
        ["npi_primary_zip", "zip5", "ZIP+4", "zip", "Zip"],
        ["npi_primary_state", "primary_state", "State", "state"],
    ),
    (
        ["npi_mailing_address_1", "mailing_address_1"],
        ["npi_mailing_city", "mailing_city"],
        ["npi_mailing_zip", "mailing_zip", "mailing_postal_code"],
        ["npi_mailing_state", "mailing_state"],
    ),
    (["mn_address_1"], ["mn_city"], ["mn_zip"], []),
)

# fixed values: default sort orders
NAME_SORT = ("last_name", "first_name", "primary_city")
LOCATION_SORT = ("zip5", "primary_city", "primary_address_1", "last_name", "first_name")

# fixed values: columns normalised by clean
TITLE_CASED_COLUMNS = ("last_name", "first_name", "middle_name", "primary_city", "mailing_city")

# fixed values: license columns joined when specialty rows are consolidated
LICENSE_TEXT_COLUMNS = (
    "license_type_desc", "license_nbr", "license_status_desc", "expire_date_char", "grant_date_char",
    "specialty boards", "certification",
)

# fixed values: wide names of the registry side and of the board side
REGISTRY_WIDE_NAMES = {
    "primary_address_1": "npi_primary_address_1",
    "primary_address_2": "npi_primary_address_2",
    "primary_city": "npi_primary_city",
    "primary_state": "npi_primary_state",
    "zip5": "npi_primary_zip",
    "primary_telephone_number": "npi_primary_phone",
    "primary_telephone": "npi_primary_phone",
    "primary_fax_number": "npi_primary_fax",
    "primary_fax": "npi_primary_fax",
    "mailing_address_1": "npi_mailing_address_1",
    "mailing_address_2": "npi_mailing_address_2",
    "mailing_city": "npi_mailing_city",
    "mailing_state": "npi_mailing_state",
    "mailing_postal_code": "npi_mailing_zip",
    "mailing_telephone": "npi_mailing_phone",
    "mailing_fax": "npi_mailing_fax",
    "source_file": "npi_source_file",
}
BOARD_WIDE_NAMES = {
    "primary_address_1": "mn_address_1",
    "primary_address_2": "mn_address_2",
    "primary_city": "mn_city",
    "primary_state": "mn_state",
    "zip5": "mn_zip",
    "source_file": "mn_source_file",
}

# fixed values: preferred order of the wide columns
WIDE_ORDER = (
    "last_name", "first_name", "middle_name", "npi",
    "npi_primary_address_1", "npi_primary_address_2", "npi_primary_city", "npi_primary_state", "npi_primary_zip",
    "npi_primary_phone", "npi_primary_fax",
    "npi_mailing_address_1", "npi_mailing_address_2", "npi_mailing_city", "npi_mailing_state", "npi_mailing_zip",
    "npi_mailing_phone", "npi_mailing_fax",
    "mn_address_1", "mn_address_2", "mn_city", "mn_state", "mn_zip",
    "license_type_desc", "degree", "license_nbr", "license_status_desc", "expire_date_char", "grant_date_char",
    "specialty boards", "certification",
    "_mn_specialty_count", "_match_type", "npi_source_file", "mn_source_file",
)

# fixed values: tab priority when the gold list is deduplicated
TAB_RANKS = {"matched": 0, "npionly": 1, "mnonly": 2}
UNKNOWN_RANK = 99

# --- survey ------------------------------------------------------------------------------------

# fixed values: texts that mean a ticked box
CHECKED_TEXTS = ("checked", "1", "yes", "true")

# fixed values: texts that are no free-text answer
NO_ANSWER_TEXTS = ("nan", "", "checked", "unchecked", "0", "1")

# fixed values: demographic questions, asked of everyone
DEMOGRAPHIC_PATTERNS = (
    "what is your profession",
    "do you primarily see pregnant",
    "how long have you been practicing",
    "what is your primary specialty",
    "what is your secondary or sub.specialty",
    "which of the following best describes your primary practice setting",
    "how would you describe the insurance status",
    "what is the county of your practice",
    "what is your gender",
    "what is your age",
    "what is your race/ethnicity",
)

# fixed values: screener questions
SCREENER_PATTERNS = (
    "provide prenatal.*delivery.*postpartum|prenatal.*delivery.*postpartum",
    "how many days.*see patients|average week.*how many",
)

# fixed values: the question that decides eligibility
ELIGIBILITY_PATTERNS = ("prenatal.*delivery.*postpartum", "provide prenatal")

# fixed values: the county question
COUNTY_PATTERN = "what is the county of your practice"

# fixed values: columns named like free text, timestamps and form status
FREE_TEXT_NAME = r"\bspecify\b|\bplease describe\b|\bexplain\b"
UNNAMED_COLUMN = r"^Unnamed:\s*\d+$"
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
COMPLETE_NAME = r"complete\??\s*$"

# fixed values: known answer scales
LIKERT = ("Strongly agree", "Agree", "Neither agree nor disagree", "Disagree", "Strongly disagree", "Don't know")
CONFIDENCE = ("Very confident", "Somewhat confident", "Not confident", "Don't know")

# fixed values: questions answered on those scales
LIKERT_PATTERNS = (
    "there is no safe level",
    "potential risks.+outweigh",
    "therapeutic reasons",
    "contraindication to breastfeeding",
    "accurately report",
    "routine toxicology screening",
    "clinicians should screen",
)
CONFIDENCE_PATTERNS = ("talk about (cannabis|tobacco|alcohol)",)

# --- retrieval ---------------------------------------------------------------------------------

# fixed values: settings
FUZZY_THRESHOLD = 0.82
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
TOP_K = 5
HISTORY_EXCHANGES = 2

# fixed values: where one sentence ends and the next begins
SENTENCE_BREAK = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\!|\?)\s+(?=[A-Z])"

# fixed values: header and lesson lines
COURSE_TITLE_LINE = r"^Course Title:\s*(.+)$"
COURSE_LINK_LINE = r"^Course Link:\s*(.+)$"
INSTRUCTOR_LINE = r"^Course Instructor:\s*(.+)$"
LESSON_LINE = r"^Lesson\s+(\d+):\s*(.+)$"
LESSON_LINK_LINE = r"^Lesson Link:\s*(.+)$"
