"""Patterns of sensitive spans, as ordered registries of (type, regular expression).

The order matters: of spans at one place with one length, the one emitted first wins.  Patterns
keep to what Java, RE2 and Python read alike: no look-around.
"""

from __future__ import annotations

# ---- Fixed values: results depend on them as they stand, so they are given whole, in their natural order.

#: What detection looks for.  The parenthesised phone needs a word character right before it, and
#: the dotted degree one right behind: both are kept as the detector defines them.
DETECTION = [
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{2}\b"),
    ("DATE", r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("MEDICAID_ID", r"\b[A-Z]{2}\d{6}\b"),
    ("PHONE", r"\b\d{3}-\d{3}-\d{4}\b"),
    ("PHONE", r"\b\(\d{3}\)\s*\d{3}-\d{4}\b"),
    ("ADDRESS", r"\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Boulevard|Blvd),\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s+[A-Z]{2}\s+\d{5}"),
    ("CREDENTIAL", r"\bBCBA\b"),
    ("CREDENTIAL", r"\bM\.A\.\b"),
    ("CREDENTIAL", r"\bMS CCC-SLP\b"),
    ("CREDENTIAL", r"\bOTR/L\b"),
    ("CREDENTIAL", r"\bRN\b"),
    ("CREDENTIAL", r"\bLCSW\b"),
]

#: What annotation looks for, before names, under the fixed rules.
TRUTH_FIXED = [
    ("MEDICAID_ID", r"\b[A-Z]{2}\d{6}\b"),
    ("PHONE", r"\b315-\d{3}-\d{4}\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{2}\b"),
    ("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("CREDENTIAL", r"\bBCBA\b"),
    ("CREDENTIAL", r"\bM\.A\.\b"),
    ("CREDENTIAL", r"\bMS CCC-SLP\b"),
    ("CREDENTIAL", r"\bOTR/L\b"),
    ("CREDENTIAL", r"\bRN\b"),
    ("CREDENTIAL", r"\bLCSW\b"),
    ("CREDENTIAL", r"\bBehavior Specialist II\b"),
    ("CREDENTIAL", r"\bPsychiatrist\b"),
    ("CREDENTIAL", r"\bOccupational Therapist\b"),
    ("CREDENTIAL", r"\bSpeech-Language Pathologist\b"),
    ("ADDRESS", r"\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Boulevard|Blvd),\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s+[A-Z]{2}\s+\d{5}"),
]

#: The legacy rules want one space and a comma in named dates.
LEGACY_DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}\b"

#: Two capitalised words, with or without an initial between them; white space may be a line break.
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+\b"

#: A legacy name must hold none of these, case and all.
LEGACY_SKIP = [
    "Upstate", "Care", "Center", "Session", "Note", "Program", "Residential", "Day",
    "Treatment", "Plan", "Behavior", "Support", "Clinical", "Supervisor", "Post", "Crisis",
]

#: A name under the fixed rules must not begin with these,
FIXED_STARTS = ["The", "This", "That", "These", "Those", "Their", "Session", "During", "After", "Before", "Following"]

#: nor hold one of these phrases in any case.
FIXED_PHRASES = [
    "Session Note", "Session Date", "Session Time", "Session Duration",
    "Service Location", "Staff Present", "Medicaid ID",
    "Date of Birth", "Client Name", "Staff Name",
    "Residential Program", "Day Program", "Treatment Plan",
    "Behavior Support", "Clinical Supervisor", "Behavioral Support",
    "Physical Aggression", "Verbal Aggression", "Self Injury",
    "Property Destruction", "Challenging Behavior", "Target Behavior",
    "Replacement Behavior", "Positive Behavior", "Appropriate Behavior",
    "Social Interaction", "Peer Interaction", "Communication Skills",
    "Emotion Regulation", "Self Care", "Daily Living",
    "Upstate Care", "Care Providers", "Geiger Center", "Miller Center",
    "Summit House", "Valley View", "Maple House", "Oak Center",
    "Pine Ridge", "Birch House", "Willow Center",
    "Crisis Intervention", "Emergency Response", "Safety Protocol",
    "Medical Emergency", "Incident Report", "Treatment Team",
    "Support Plan", "Progress Report", "Review Meeting",
    "Puzzle Completion", "Card Matching", "Color Sorting",
    "Shape Recognition", "Number Recognition", "Letter Recognition",
    "Post Crisis", "Pre Session", "Follow Up",
    "Next Session", "Previous Session", "Session Summary",
    "Occupational Therapy", "Speech Therapy", "Physical Therapy",
    "Applied Behavior", "Functional Behavior", "Behavior Analysis",
]

# ---- End of the fixed values.

TRUTH = {
    "fixed": TRUTH_FIXED,
    "legacy": [(kind, LEGACY_DATE if "January" in p else p) for kind, p in TRUTH_FIXED],
}
