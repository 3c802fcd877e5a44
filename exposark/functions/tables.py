"""The engine's rule tables. All of these are fixed values of the scoring and advice rules."""

from __future__ import annotations

DOCUMENT_WEIGHTS = {"aadhaar": 50, "pan_card": 45, "password": 40, "credit_card": 40, "cvv": 38, "otp": 30, "id_number": 30, "dob": 25, "person_name": 20, "email": 18, "phone": 15}
DOCUMENT_DEFAULT = 10
HARD_TYPES = ("aadhaar", "pan_card", "credit_card", "password", "cvv")
SOFT_TYPES = ("person_name", "location", "organization", "demographic", "date", "id_number")
CALM_DOCUMENTS = ("ml_notebook", "project_synopsis", "generic", "academic", "unknown")
SOFT_CAP = 15

URL_WEIGHTS = {"credit_card": 35, "cvv": 40, "aadhaar": 30, "password": 25, "pan": 20, "otp": 15, "dob": 8, "phone": 8, "http_only": 8, "email": 5, "personal_email": 5, "public_contact": 1, "public_phone": 1}
SOCIAL_WEIGHTS = {"email": 25, "phone": 28, "website": 8, "username": 5, "display_name": 6, "location": 10, "bio": 7, "company": 6, "face_detected": 8, "id_card_visible": 40}
SCREEN_WEIGHTS = {"aadhaar": 50, "pan": 45, "credit_card": 40, "password": 40, "otp": 35, "dob": 25, "face_detected": 20, "email": 18, "phone": 15}
METADATA_WEIGHTS = {
    "gps_full": 30, "gps_latitude": 15, "gps_longitude": 15, "email_in_metadata": 20, "phone_in_metadata": 20, "author": 15, "creator": 15, "last_modified_by": 15, "company": 10, "local_path": 25,
    "tracked_changes": 20, "user_comment": 20, "camera_model": 15, "camera_make": 10, "software": 5, "artist": 10, "keywords": 2, "revision": 0, "creation_date": 0, "modification_date": 0, "title": 0, "subject": 0, "category": 0,
}

#: Least scores by profile; a level without a number is never reached, and "hard" needs a hard type too.
RISK_PROFILES = {
    "document": {"CRITICAL": (80, "hard"), "HIGH": (35, ""), "MEDIUM": (15, ""), "else": "LOW"},
    "cloud": {"CRITICAL": (80, "hard"), "HIGH": (35, ""), "MEDIUM": (15, ""), "else": "LOW"},
    "batch": {"CRITICAL": (80, "hard"), "HIGH": (35, ""), "MEDIUM": (15, ""), "LOW": (10, ""), "else": "SAFE"},
    "url": {"CRITICAL": (75, ""), "HIGH": (35, ""), "MEDIUM": (15, ""), "LOW": (0, "over"), "else": "SAFE"},
    "screen": {"CRITICAL": (75, ""), "HIGH": (45, ""), "MEDIUM": (20, ""), "LOW": (10, ""), "else": "SAFE"},
    "social": {"CRITICAL": (45, ""), "HIGH": (25, ""), "MEDIUM": (12, ""), "LOW": (5, ""), "else": "SAFE"},
    "metadata": {"CRITICAL": (75, ""), "HIGH": (45, ""), "MEDIUM": (20, ""), "LOW": (5, ""), "else": "SAFE"},
    "agent": {"CRITICAL": (75, ""), "HIGH": (35, ""), "MEDIUM": (15, ""), "else": "LOW"},
    "aggregate": {"CRITICAL": (75, ""), "HIGH": (35, ""), "MEDIUM": (15, ""), "else": "LOW"},
}
RISK_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "SAFE": 0}

#: Severity of the advice for a type: (up to n findings, severity), then the severity beyond.
ADVICE = (
    ("email", 2, "MEDIUM", "HIGH"), ("phone", 0, "HIGH", "HIGH"), ("password", 0, "HIGH", "HIGH"), ("aadhaar", 0, "HIGH", "HIGH"), ("pan_card", 0, "HIGH", "HIGH"), ("credit_card", 0, "HIGH", "HIGH"), ("cvv", 0, "HIGH", "HIGH"),
    ("dob", 0, "MEDIUM", "MEDIUM"), ("otp", 0, "HIGH", "HIGH"), ("person_name", 0, "MEDIUM", "MEDIUM"), ("location", 0, "MEDIUM", "MEDIUM"), ("organization", 0, "LOW", "LOW"), ("id_number", 0, "MEDIUM", "MEDIUM"), ("date", 0, "LOW", "LOW"),
    ("financial", 1, "MEDIUM", "HIGH"), ("demographic", 0, "LOW", "LOW"), ("face_detected", 0, "HIGH", "HIGH"), ("id_card_visible", 0, "HIGH", "HIGH"), ("document_type", 0, "MEDIUM", "MEDIUM"), ("signature_visible", 0, "MEDIUM", "MEDIUM"), ("qr_barcode", 0, "MEDIUM", "MEDIUM"),
)
URGENCY = {"aadhaar": "IMMEDIATE", "pan_card": "IMMEDIATE", "credit_card": "IMMEDIATE", "cvv": "IMMEDIATE", "password": "IMMEDIATE", "email": "WITHIN_24H", "phone": "WITHIN_24H", "otp": "IMMEDIATE", "dob": "WITHIN_WEEK", "face_detected": "WITHIN_24H", "id_card_visible": "IMMEDIATE"}
URGENCY_DEFAULT = "WITHIN_WEEK"
URGENCY_RANK = {"IMMEDIATE": 0, "WITHIN_24H": 1, "WITHIN_WEEK": 2}

SCENARIOS = (
    ("phishing_email", "HIGH", ("email",), ("person_name", "organization")),
    ("sim_swap", "CRITICAL", ("phone",), ("person_name", "aadhaar")),
    ("credential_stuffing", "CRITICAL", ("email", "password"), ()),
    ("aadhaar_impersonation", "CRITICAL", ("aadhaar",), ("person_name", "phone")),
    ("gps_stalking", "CRITICAL", ("gps_latitude",), ("gps_longitude", "gps_full")),
    ("spear_phishing", "HIGH", ("email", "person_name"), ("organization",)),
    ("account_takeover", "HIGH", ("email", "phone"), ()),
    ("data_broker_profile", "MEDIUM", ("person_name",), ("email", "phone", "organization")),
    ("pan_financial_fraud", "CRITICAL", ("pan_card",), ("person_name", "phone")),
    ("cvv_card_fraud", "CRITICAL", ("credit_card", "cvv"), ("person_name",)),
    ("otp_account_takeover", "CRITICAL", ("otp",), ("phone", "email")),
    ("id_document_impersonation", "CRITICAL", ("id_card_visible",), ("id_number", "person_name")),
    ("face_spoofing", "HIGH", ("face_detected",), ("person_name", "id_card_visible")),
    ("qr_exploitation", "HIGH", ("qr_barcode",), ("person_name",)),
    ("signature_forgery", "MEDIUM", ("signature_visible",), ("person_name", "id_card_visible")),
    ("social_profile_attack", "MEDIUM", ("username",), ("display_name", "bio", "location", "website")),
    ("http_mitm", "MEDIUM", ("http_only",), ("email", "password")),
)
#: Scenarios of types together, and of types (any of them) that must be absent.
COMBINED_SCENARIOS = (
    ("card_cloning", "CRITICAL", ("credit_card",), ()),
    ("full_kyc_theft", "CRITICAL", ("aadhaar", "pan_card"), ()),
)
#: Scenarios of types together that stand unless one of some other scenarios does.
DYNAMIC_SCENARIOS = (
    ("location_phishing", "HIGH", ("email", "location"), ("phishing_email",)),
    ("impersonation", "HIGH", ("person_name", "organization", "location"), ("spear_phishing",)),
    ("birthday_social_eng", "MEDIUM", ("dob", "person_name"), ()),
    ("identity_aggregation", "HIGH", ("phone", "email", "person_name"), ("account_takeover",)),
)
SEVERITY_POINTS = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 4}
ALIASES = {"display_name": "person_name", "author": "person_name", "creator": "person_name", "last_modified_by": "person_name", "artist": "person_name", "company": "organization", "pan": "pan_card"}

CONFIDENCE = {"email": 0.85, "phone": 0.80, "aadhaar": 0.90, "pan_card": 0.90, "credit_card": 0.78, "cvv": 0.72, "otp": 0.65, "password": 0.55, "dob": 0.70, "person_name": 0.50, "id_number": 0.60}

KEYWORD_RULES = (
    ("project_synopsis", 2, ("problem statement", "literature review", "future scope", "objective", "synopsis", "project report", "methodology", "academic year", "references", "unit 1")),
    ("ml_notebook", 2, ("sklearn", "import pandas", "import numpy", "from sklearn", "lab manual", "experiment", "import torch", "matplotlib", "knn", "k-means", "def ", "lab program")),
    ("aadhaar_card", 1, ("aadhaar", "uidai", "uid", "enrolment no")),
    ("pan_card_doc", 1, ("permanent account number", "pan card", "income tax")),
    ("passport", 1, ("passport", "republic of india", "nationality")),
    ("bank_statement", 2, ("account no", "ifsc", "opening balance", "statement")),
    ("payslip", 2, ("gross salary", "net pay", "epf", "payslip", "ctc")),
    ("medical", 2, ("patient name", "diagnosis", "prescription", "dosage")),
    ("resume", 2, ("curriculum vitae", "resume", "work experience", "skills")),
    ("marks_card", 2, ("marks obtained", "cgpa", "semester", "grade card")),
    ("invoice", 2, ("invoice", "gstin", "total amount", "bill to")),
    ("screenshot_credential", 2, ("change your password", "your account is at risk", "re-type new password", "password", "sign in", "login", "otp", "two-factor", "enter your password", "forgot password", "reset password")),
)
TYPE_BOOST = {"passport": 15, "bank_statement": 12, "payslip": 15, "medical": 15, "resume": 10, "aadhaar_card": 5, "pan_card_doc": 5, "marks_card": 5, "invoice": 5, "driving_license": 8, "student_id": 5, "insurance": 8, "gov_form": 8, "screenshot_credential": 25, "screenshot_chat": 5, "screenshot_social": 5}
#: Types that stand only beside a finding of one of these.
NEEDED_EVIDENCE = {
    "aadhaar_card": ("aadhaar",), "pan_card_doc": ("pan_card",), "screenshot_credential": ("password", "otp"), "driving_license": ("id_number", "dob", "person_name"),
    "passport": ("id_number", "dob", "person_name"), "student_id": ("id_number", "person_name"), "marks_card": ("id_number", "person_name", "dob"),
}

PLATFORMS = (("twitter.com", "twitter"), ("x.com", "twitter"), ("linkedin.com", "linkedin"), ("reddit.com", "reddit"), ("instagram.com", "instagram"), ("github.com", "github"))
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "169.254.169.254", "metadata.google.internal")
CONTENT_TYPES = {"application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "text/plain": ".txt", "text/html": ".html", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx"}
MAGIC = (("25504446", ".pdf"), ("89504E47", ".png"), ("FFD8FF", ".jpg"), ("47494638", ".gif"), ("504B0304", ".docx"))

#: Document types by keywords: type, points, keywords of which one must be there, further keywords, least number of keywords.
TYPE_RULES = (
    ("passport", 15, ("passport",), ("republic of india", "nationality", "place of birth", "date of issue", "date of expiry", "passport no", "given names", "surname"), 2),
    ("aadhaar_card", 5, ("aadhaar", "uid"), ("uidai", "enrolment no", "enrollment no", "unique identification", "government of india", "your aadhaar"), 1),
    ("pan_card_doc", 5, ("permanent account number",), ("income tax department", "govt of india", "income tax", "assessee"), 1),
    ("bank_statement", 12, ("account no", "account number"), ("ifsc", "statement period", "opening balance", "closing balance", "cr", "dr", "transaction date", "debit", "credit", "bank statement", "passbook", "mini statement"), 2),
    ("payslip", 15, (), ("gross salary", "net pay", "net salary", "basic salary", "deductions", "employee id", "employee code", "pf no", "pf number", "provident fund", "epf", "esi", "tds", "salary slip", "pay slip", "payslip", "ctc", "cost to company", "take home"), 3),
    ("medical", 15, (), ("patient name", "patient id", "diagnosis", "prescription", "dosage", "medicine", "mg", "doctor", "dr.", "hospital", "clinic", "opd", "blood group", "lab report", "test result", "symptoms", "medical report", "discharge summary", "blood pressure", "pulse rate"), 3),
    ("resume", 10, (), ("curriculum vitae", "resume", "work experience", "professional experience", "objective", "career objective", "references", "internship", "skills", "education", "projects", "achievements", "hobbies", "declaration", "date of birth", "marital status", "nationality"), 4),
    ("marks_card", 5, (), ("marks obtained", "maximum marks", "grade", "cgpa", "gpa", "semester", "examination", "university", "roll no", "hall ticket", "result", "pass", "fail", "distinction", "subject code", "marks card", "grade card", "transcript"), 3),
    ("invoice", 5, (), ("invoice no", "invoice number", "bill to", "ship to", "total amount", "gst no", "gstin", "taxable amount", "cgst", "sgst", "igst", "subtotal", "grand total", "due date", "payment terms"), 3),
    ("project_synopsis", 0, (), ("problem statement", "project planning", "future scope", "literature survey", "technical specifications", "synopsis", "under the guidance of", "department of", "bachelor of engineering", "master of technology", "college of engineering", "vtu", "usn", "uucms", "uucms no", "project report", "academic year", "visvesvaraya technological university", "proposed system", "methodology", "system design", "implementation details", "theta dynamics", "motivation", "deliverables", "background", "streamlit", "objectives", "milestones", "abstract", "introduction", "conclusions", "appendix", "project scope"), 2),
    ("ml_notebook", 0, (), ("sklearn", "scikit", "pandas", "numpy", "matplotlib", "seaborn", "train_test_split", "cross_val_score", "gridsearchcv", "k-nearest", "k-means", "kmeans", "knn", "breast cancer", "iris dataset", "mnist", "classification report", "confusion matrix", "random forest", "decision tree", "neural network", "tensorflow", "pytorch", "keras", "jupyter", "notebook", "colab", "import pandas", "import numpy", "import sklearn", "from sklearn"), 2),
    ("screenshot_credential", 25, (), ("change your password", "reset password", "new password", "current password", "confirm password", "enter password", "forgot password", "password expired", "your account", "sign in", "log in", "login", "two-factor", "2fa", "verification code", "one time password", "otp", "security code", "unlock", "unlock pattern", "unlock pin", "password is at risk", "password was found", "compromised"), 2),
)
#: Two of these make an identity document without its number a project paper.
PAPER_WORDS = ("problem statement", "project planning", "future scope", "literature survey", "synopsis", "under the guidance of", "department of", "bachelor of engineering", "college of engineering", "vtu", "usn", "uucms", "uucms no", "project report", "academic year", "theta dynamics", "motivation", "deliverables", "background", "streamlit", "objectives", "milestones", "abstract", "introduction", "conclusions", "appendix", "project scope")
#: Any of these anywhere in a text makes it academic, and its unlabelled tokens no passwords.
ACADEMIC_WORDS = ("synopsis", "academic", "semester", "project report", "problem statement", "guided by", "submitted by", "literature survey", "future scope", "vtu", "usn", "uucms", "syllabus", "curriculum", "marks card", "grade card", "examination", "sklearn", "scikit", "import pandas", "import numpy", "import sklearn", "from sklearn", "load_breast_cancer", "train_test_split", "cross_val_score", "k-nearest", "k-means", "kmeans", "knn", "breast cancer", "iris dataset", "confusion matrix", "random forest", "decision tree", "neural network", "matplotlib", "seaborn", "jupyter", "notebook", "colab", "ipynb", "def ", "import ", "print(", "return ", "class ", "self.")
CREDENTIAL_TYPES = ("password", "email", "otp", "credit_card", "cvv", "aadhaar", "pan_card")
CALM_TYPES = ("project_synopsis", "ml_notebook")
ENTITY_SOFT_TYPES = ("person_name", "organization", "location", "demographic", "date")
#: Words that are never a person's name after a label.
NO_NAMES = ("date", "time", "year", "month", "day", "name", "place", "address", "city", "state", "country", "pincode", "phone", "mobile", "email", "fax", "gender", "male", "female", "age", "roll", "class", "subject", "course", "department", "college", "university", "school", "institute", "number", "serial", "code", "reference", "designation", "position", "signature", "sign", "stamp", "seal", "total", "amount", "nationality", "occupation", "father", "mother", "husband", "wife", "guardian", "principal", "officer", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")
#: Lines of pages that are navigation.
NAVIGATION = "home|about|contact|login|sign\\s*in|sign\\s*up|register|menu|search|toggle|skip|close|open|back|next|prev|submit|cancel|read\\s*more|learn\\s*more|click\\s*here|download|upload|view|facebook|twitter|instagram|linkedin|youtube|whatsapp|accept\\s*cookies?|cookie\\s*policy|privacy\\s*policy|terms"
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "noscript", "menu", "form", "iframe", "svg", "figure", "button", "select", "option", "dialog", "template", "cookie", "banner")
PLACEHOLDERS = ("none", "null", "unknown", "undefined", "n/a", "na", "(anonymous)", "(unspecified)", "(none)", "(unknown)", "anonymous", "unspecified")
SOURCE_LABELS = {"file": "Upload & Scan", "url": "URL Scanner", "social": "Social Scanner", "cloud": "Cloud Scanner", "screen": "Screen Monitor", "custom": "Custom"}
SOURCE_COLOURS = {"file": "#60a5fa", "url": "#22d3ee", "social": "#c084fc", "cloud": "#38bdf8", "screen": "#f87171", "metadata_image": "#fb923c", "metadata_word": "#fb923c", "metadata_excel": "#fb923c", "metadata_pdf": "#fb923c"}
SOURCE_COLOUR_DEFAULT = "#94a3b8"
TYPE_LABELS = {"email": "Email Address", "phone": "Phone Number", "aadhaar": "Aadhaar Number", "pan": "PAN Card", "pan_card": "PAN Card", "credit_card": "Credit Card", "password": "Password", "otp": "OTP / PIN", "dob": "Date of Birth", "face_detected": "Face / Photo", "id_card_visible": "ID Card", "location": "Location Data", "username": "Username", "display_name": "Full Name", "bio": "Personal Bio", "website": "Website Link", "person": "Person Name", "name": "Person Name"}
FIELD_LABELS = {"author": "Document Creator", "creator": "Document Creator", "last_modified_by": "Last Editor Name", "revision": "Document Edit Count", "creation_date": "File Created On", "modification_date": "File Last Modified", "gps_full": "GPS Physical Location", "gps_latitude": "GPS Latitude", "gps_longitude": "GPS Longitude", "camera_model": "Device Model", "camera_make": "Device Manufacturer", "software": "Creation Software", "company": "Organization / Company", "user_comment": "Embedded Comments", "artist": "Artist / Owner", "copyright": "Copyright Holder", "doc_title": "Document Title", "subject": "Document Subject", "keywords": "Tags / Keywords", "category": "Document Category", "page_count": "Total Pages", "word_count": "Total Words", "sheet_count": "Total Sheets", "revision_count": "Revision Count"}
#: Attack that a type of finding makes possible: type, name, severity.
ATTACKS = (
    ("email", "Phishing / Credential Stuffing", "HIGH"), ("phone", "SIM Swap / Vishing", "HIGH"), ("password", "Direct Account Takeover", "CRITICAL"), ("aadhaar", "Identity Fraud / KYC Bypass", "CRITICAL"), ("pan_card", "Tax / Financial Fraud", "CRITICAL"),
    ("credit_card", "Financial Theft", "CRITICAL"), ("cvv", "Immediate Card Fraud", "CRITICAL"), ("otp", "2FA Bypass", "HIGH"), ("dob", "Identity Correlation", "MEDIUM"), ("face_detected", "Biometric Spoofing", "HIGH"), ("id_card_visible", "Document Forgery", "CRITICAL"),
    ("person_name", "Social Engineering", "MEDIUM"), ("location", "Physical Threat", "MEDIUM"),
)
