"""Closed vocabularies of annotations (fixed values)."""

LABELS = ("DRUG", "STRENGTH", "DOSE", "FORM", "ROUTE", "FREQUENCY", "DURATION", "TIMING", "INSTRUCTION")
RELATIONS = tuple(f"HAS_{x}" for x in LABELS[1:])
STATUSES = ("partial", "complete", "needs_review")
ROLES = ("annotator-a", "annotator-b", "reviewer")
VERIFIABLE = ("drug", "strength", "dose", "frequency", "duration", "timing", "route", "instruction")

# Source labels and field names by normalised key. Both tables are grouped by
# label, as one test is built for each label; keys that normalising never gives are left out.
LABEL_KEYS = {
    "DRUG": ("drug", "medicine", "medication", "drugname", "thuoc"),
    "ACTIVE_INGREDIENT": ("activeingredient", "ingredient", "hoatchat"),
    "STRENGTH": ("strength", "dosagestrength", "hamluong"),
    "DOSE": ("dose", "dosage", "lieu"),
    "FORM": ("form", "dosageform"),
    "ROUTE": ("route", "administrationroute", "duongdung"),
    "FREQUENCY": ("frequency", "tansuat", "solan"),
    "DURATION": ("duration", "thoigian"),
    "TIMING": ("timing", "meal"),
    "INSTRUCTION": ("instruction", "directions", "usage", "huongdan"),
}
FIELD_KEYS = {
    "DRUG": ("drug", "drugname", "medication", "medicationname", "medicine", "thuoc"),
    "STRENGTH": ("strength", "dosagestrength", "hamluong"),
    "DOSE": ("dose", "dosage", "lieu"),
    "FORM": ("form", "dosageform"),
    "ROUTE": ("route", "administrationroute", "duongdung"),
    "FREQUENCY": ("frequency", "freq", "tansuat"),
    "DURATION": ("duration",),
    "TIMING": ("timing", "meal"),
    "INSTRUCTION": ("instruction", "directions", "usage", "huongdan"),
}
