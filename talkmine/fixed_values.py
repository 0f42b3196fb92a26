"""Fixed values.

Word lists, lookup tables, patterns and formats that results depend on. They are data,
stated as they must be; every function that uses one also accepts a replacement.
"""

# Link formats.
WATCH_URL = "https://www.youtube.com/watch?v="
CHANNEL_URL = "https://www.youtube.com/channel/"

# Bracketed noise markers.
LOAD_MARKERS = ["[Music]", "[Applause]", "[Laughter]", "[Cheering]", "[Silence]", "[Inaudible]"]
CLEAN_MARKERS = ["[Music]", "[Applause]", "[Laughter]", "[Cheering]", "[Inaudible]"]
FLAG_MARKERS = ["[Music]", "[Applause]", "[Laughter]"]
HTML_ENTITIES = ["&amp;", "&gt;", "&lt;", "&nbsp;"]

# Lower bounds of HIGH and MEDIUM by coverage.
COVERAGE_TIERS = {"view": (0.9, 0.7), "chunk": (0.85, 0.65)}
# Composite score above 0.7 is HIGH, from 0.5 MEDIUM.
SCORE_TIERS = (0.7, 0.5)

# Value domains.
ROLES = ["HOST", "GUEST", "UNKNOWN"]
CLAIM_TYPES = ["VERIFIABLE_FACT", "PREDICTION", "OPINION", "STATISTICAL"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]
SENTIMENTS = ["positive", "negative", "neutral"]
DRIFT_TYPES = ["REVISED", "ESCALATED", "SOFTENED", "CONTRADICTED", "CONFIRMED"]
STATUSES = ["PENDING", "VERIFIED", "OUTDATED", "DISPUTED", "UNVERIFIED", "FALSE"]

# Columns of a search result.
RESULT_COLUMNS = [
    "chunk_text", "episode_title", "channel_name", "youtube_url", "publish_date", "chunk_id",
]

# Genre by channel folder, in lookup order.
GENRES = {
    "lex_fridman_podcast": "Technology & AI",
    "all_in_podcast": "Technology & AI",
    "no_priors": "Technology & AI",
    "acquired_podcast": "Technology & AI",
    "a16z_podcast": "Technology & AI",
    "hard_fork__nyt": "Technology & AI",
    "the_cognitive_revolution": "Technology & AI",
    "the_tim_ferriss_show": "Business & Entrepreneurship",
    "my_first_million": "Business & Entrepreneurship",
    "lenny_s_podcast": "Business & Entrepreneurship",
    "wondery__how_i_built_this": "Business & Entrepreneurship",
    "y_combinator": "Business & Entrepreneurship",
    "the_knowledge_project": "Business & Entrepreneurship",
    "huberman_lab": "Science & Health",
    "the_peter_attia_drive": "Science & Health",
    "foundmyfitness": "Science & Health",
    "startalk": "Science & Health",
    "impact_theory": "Education & Self-Improvement",
    "deep_dive_with_ali_abdaal": "Education & Self-Improvement",
    "the_diary_of_a_ceo": "Education & Self-Improvement",
    "founders_podcast": "Education & Self-Improvement",
    "modern_wisdom": "Education & Self-Improvement",
    "20vc_with_harry_stebbings": "Startup & VC",
    "masters_of_scale": "Startup & VC",
    "joe_rogan_experience": "Cross-Disciplinary",
}

# Episodes to add per channel and year, shortest episode in minutes.
YEAR_TARGETS = [
    ("All-In Podcast", {2022: 3, 2023: 3, 2024: 2}, 30.0),
    ("a16z Podcast", {2022: 2, 2023: 3, 2024: 3}, 30.0),
    ("Joe Rogan Experience", {2022: 2, 2023: 2, 2024: 2}, 60.0),
    ("My First Million", {2022: 2, 2023: 2, 2024: 2}, 30.0),
    ("The Diary of a CEO", {2022: 2, 2023: 2, 2024: 2}, 30.0),
    ("Huberman Lab", {2022: 2, 2023: 2, 2024: 2}, 30.0),
]

# Words that are never a guest name on their own.
GENERIC_NAMES = ["Huberman Lab Essentials", "Interview", "Podcast", "Bonus", "Summary"]

# Hosts and ordered title patterns per channel; no patterns = solo show.
SHOWS = [
    ("20VC with Harry Stebbings", ["Harry Stebbings"], [
        r",\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
        r"(?:CEO|Founder|Partner|Head|GP|CTO|COO|President)\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
    ]),
    ("Acquired", ["Ben Gilbert", "David Rosenthal"], [
        r"\(with\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\)",
        r"(?:CEO|founder|Co-Founder|Chairman)\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
        r"^The\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+Interview",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*(?:\(Audio\))?$",
    ]),
    ("Ali Abdaal", ["Ali Abdaal"], []),
    ("All-In Podcast", ["Chamath Palihapitiya", "Jason Calacanis", "David Sacks", "David Friedberg"], [
        r"[Ii]n conversation with (.+?)(?:\s*\|.*)?$",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-.]+)?):",
        r"([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+vs\.?\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
    ]),
    ("Andrew Huberman", ["Andrew Huberman"], [
        r"\|\s*((?:Dr\.\s+)?[A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-\.]+)+)\s*$",
        r"^(Dr\.\s+[A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
    ]),
    ("Chris Williamson", ["Chris Williamson"], [
        r"\s+-\s+((?:Dr\.?\s+)?[A-Z][a-zA-Z\-]+(?:\s+[a-zA-Z\-]+)*)\s*(?:\(\d+K\))?$",
    ]),
    ('Cognitive Revolution "How AI Changes Everything"', ["Nathan Labenz", "Erik Torenberg"], [
        r"\bw[/\-]\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
        r"\bwith\s+(?:\w+\s+){0,3}([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
    ]),
    ("FoundMyFitness", ["Rhonda Patrick"], [
        r"^(Dr\.\s+[A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+),\s*(?:PhD|MD|DO)\s*:",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+),\s*(?:PhD|MD|DO),\s*on\b",
        r"\|\s*((?:Dr\.\s+)?[A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
    ]),
    ("Founders Podcast", ["David Senra"], [
        r"^(?:How|The Story of|Lessons from)\s+([A-Z][a-zA-Z\-]+(?:'s)?\s+[A-Z][a-zA-Z\-]+)",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+and",
    ]),
    ("Hard Fork", ["Kevin Roose", "Casey Newton"], [
        r"\bwith\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)(?:\s*[\.!\|]|$)",
        r"\bMeet\s+(?:\w+\s+){0,3}([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+(?:of|on|talks)\b",
        r"(?:CEO|C\.E\.O\.|Founder)\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+on\b",
    ]),
    ("Lenny's Podcast", ["Lenny Rachitsky"], [
        r"\|\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)(?:\s*\([^)]+\))?$",
        r":\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*(?:\([^)]+\))?$",
        r"^([A-Z][a-zA-Z\-']+\s+[A-Z][a-zA-Z\-']+)\s*:",
    ]),
    ("Lex Fridman", ["Lex Fridman"], [
        r"^([A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-\.]+)+)\s*:",
        r"^([A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-\.]+)+)\s+Interview",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+vs",
    ]),
    ("Masters of Scale", ["Reid Hoffman"], [
        r"\(with\s+(?:\w+\s+){0,3}([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\)",
        r"^[A-Za-z0-9'\-]+['s]?\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
        r"^([A-Z][a-zA-Z\-]+\s+(?:&\s+[A-Z][a-zA-Z\-]+\s+)?[A-Z][a-zA-Z\-]+)\s*:",
        r"\bwith\s+(?:[A-Za-z0-9'\-]+['s]?\s+)?([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
    ]),
    ("My First Million", ["Sam Parr", "Shaan Puri"], [
        r"\|\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+Interview$",
        r"\|\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
        r"\s+-\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
        r"^Confronting\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+",
    ]),
    ("No Priors: AI, Machine Learning, Tech, & Startups", ["Sarah Guo", "Elad Gil"], [
        r"\|\s*[Ww]ith\s+(?:(?:[A-Z][a-z]+\s+){0,3})?([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
        r"\|\s*[Ww]ith\s+.+?([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
        r"(?:CEO|Founder|Co-Founder|President)\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
    ]),
    ("Peter Attia MD", ["Peter Attia"], [
        r"\bwith\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
    ]),
    ("PowerfulJRE", ["Joe Rogan"], [
        r"#\d+\s+-\s+(.+)$",
    ]),
    ("StarTalk", ["Neil deGrasse Tyson"], [
        r"\bWith\s+([A-Z][a-zA-Z\-\.]+(?:\s+[a-zA-Z\-\.]+)*)$",
        r"\bwith\s+.+?,\s+((?:Dr\.\s+)?[A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
        r"\bwith\s+([A-Za-z0-9]+(?:[A-Z][a-zA-Z\-]+)?)\s*$",
    ]),
    ("The Diary Of A CEO", ["Steven Bartlett"], [
        r"^([A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-\.]+)+)\s*:",
        r"\s+-\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*(?:\|.*)?$",
        r":\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
    ]),
    ("The Knowledge Project Podcast", ["Shane Parrish"], [
        r"^((?:Dr\.\s+)?[A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
        r"conversation with\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
        r"\|\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*$",
    ]),
    ("Tim Ferriss", ["Tim Ferriss"], [
        r"^([A-Z][a-zA-Z\-]+(?:\s+[A-Z][a-zA-Z\-\.]+)+)\s*[—‒–]",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+and\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+),\s*(?:Ph\.D\.|MD|PhD)",
    ]),
    ("Tom Bilyeu", ["Tom Bilyeu"], []),
    ("Wondery", ["Guy Raz"], [
        r"\bwith\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)(?:\s*\||\s*$)",
    ]),
    ("Y Combinator", ["Garry Tan", "Harj Taggar"], [
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
        r"^([A-Z][a-zA-Z\-]+(?:\s+[a-zA-Z\-]+)?\s+[A-Z][a-zA-Z\-]+)\s*:",
    ]),
    ("a16z", ["Marc Andreessen", "Ben Horowitz", "a16z Partners"], [
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+on\b",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*(?:&|and)\s*([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s*:",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)'s\b",
        r"^([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)\s+on\s+the\b",
        r"\bwith\s+([A-Z][a-zA-Z\-]+\s+[A-Z][a-zA-Z\-]+)",
    ]),
]
