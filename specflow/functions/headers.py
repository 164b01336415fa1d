"""Patterns that say where a section of an article begins and ends, and what a paragraph is about.

All are matched at the beginning of a trimmed line, in any case, but those of ``REDIRECT`` and ``SYNTHESIS``, which are searched for.
"""

from __future__ import annotations

# Headers that begin an experimental section for certain.
STRICT = [
    r"^\s*\d+\.?\s*Experimental\s+Section\s*$",
    r"^\s*\d+\.?\s*Experimental\s+Procedures?\s*$",
    r"^\s*\d+\.?\s*Experimental\s+Details?\s*$",
    r"^\s*\d+\.?\s*Experimental\s+Methods?\s*$",
    r"^\s*\d+\.?\s*Experimental\s*$",
    r"^\s*\d+\.?\s*Experiments?\s*$",
    r"^\s*\d+\.?\s*Experiments?\s+Section\s*$",
    r"^\s*\d+\.?\s*Materials?\s+and\s+Methods?\s*$",
    r"^\s*\d+\.?\s*Methods?\s+and\s+Materials?\s*$",
    r"^\s*\d+\.?\s*Methods\s*$",
    r"^\s*Experimental\s+Section\s*$",
    r"^\s*Experimental\s+Procedures?\s*$",
    r"^\s*Experimental\s+Details?\s*$",
    r"^\s*Experimental\s*$",
    r"^\s*Experiments?\s*$",
    r"^\s*Materials?\s+and\s+Methods?\s*$",
    r"^\s*STAR\s*[\+\★]\s*METHODS\s*$",
    r"^\s*STAR\s*METHODS\s*$",
    r"^\s*Method\s+Details?\s*$",
]

# Headers that may begin one, looked for where there is none of the above.
RELAXED = [
    r"^\s*\d+\.\d+\.?\s*Synthesis\s+of\s+.{0,50}$",
    r"^\s*\d+\.\d+\.?\s*Preparation\s+of\s+.{0,50}$",
    r"^\s*\d+\.\d+\.?\s*Synthesis\s*$",
    r"^\s*\d+\.\d+\.?\s*Sample\s+Preparation\s*\.?$",
    r"^\s*\d+\.\d+\.?\s*Materials?\s*$",
    r"^\s*\d+\.\d+\.?\s*Chemicals?\s*$",
    r"^\s*Sample\s+Preparation\s*\.?\s*$",
    r"^\s*Catalyst\s+(?:synthesis|preparation)\s",
    r"^\s*\d+\.?\d*\.?\s*Experiment\s+[Ss]ection\s*$",
    r"^\s*\d+\.?\s*Experimental\s+\w",
    r"^\s*\d+\.Experimental",
    r"^\s*S?\d+\.?\s*Experimental\s+Details?\s*$",
    r"^\s*S?\d+\.?\s*Experimental\s*$",
    r"^\s*Synthesis\s+of\s+.{0,40}g-?C\s*3\s*N\s*4",
    r"^\s*Preparation\s+of\s+.{0,40}g-?C\s*3\s*N\s*4",
    r"^\s*\d+\.\d+\.?\s*Synthesisof",
    r"^\s*\d+\.\d+\.?\s*Preparationof",
    r"^\s*Preparationof.{0,30}g-?C\s*3\s*N\s*4",
    r"^\s*\d+\.?\s*Characterizations?\s*$",
    r"^\s*Experimental\s+procedure\s+for\s+",
    r"^\s*Detailed\s+methods\s+are\s+provided\s+",
]

# Headers that end a section wherever they are.
STRONG = [
    r"^\s*\d+\.?\s*Results?\s+and\s+Discussions?\s*$",
    r"^\s*\d+\.?\s*Results?\s*$",
    r"^\s*\d+\.?\s*Discussions?\s*$",
    r"^\s*\d+\.?\s*Conclusions?\s*$",
    r"^\s*\d+\.?\s*Summary\s*$",
    r"^\s*Results?\s+and\s+Discussions?\s*$",
    r"^\s*Results?\s+and\s+Characterizations?\s*$",
    r"^\s*Conclusions?\s*$",
    r"^\s*\d*\.?\s*Acknowledg[e]?ments?\s*$",
    r"^\s*ACKNOWLEDG",
    r"^\s*\d*\.?\s*References?\s*$",
    r"^\s*Bibliography\s*$",
    r"^\s*Author\s+Contributions?\s*$",
    r"^\s*Conflicts?\s+of\s+Interest\s*$",
    r"^\s*Declaration\s+of\s+",
    r"^\s*Data\s+Availability\s*$",
    r"^\s*CRediT\s+",
    r"^\s*\d*\.?\s*Supporting\s+Information\s*$",
    r"^\s*\d*\.?\s*Supplementary\s+",
    r"^\s*ASSOCIATED\s+CONTENT",
    r"^\s*QUANTIFICATION\s+AND\s+STATISTICAL",
    r"^\s*DATA\s+AND\s+CODE\s+AVAILABILITY",
]

# Headers that end it only behind so many words, and the most characters of a section and of a header.
WEAK = [
    r"^\s*Results?\s*$",
    r"^\s*Discussions?\s*$",
    r"^\s*Characterizations?\s*$",
]
WORDS_BEFORE_WEAK, LONGEST_SECTION, LONGEST_HEADER = 150, 20_000, 100

# Signs that the details are in a supplement.
REDIRECT = [
    r"detailed?\s+in\s+(?:the\s+)?support",
    r"provided\s+in\s+(?:the\s+)?support",
    r"see\s+(?:the\s+)?support",
    r"(?:in|see)\s+(?:the\s+)?(?:electronic\s+)?supplementary",
    r"described\s+in\s+(?:the\s+)?SI",
    r"(?:in|see)\s+ESI",
]

# Signs of a paragraph on synthesis.
SYNTHESIS = [
    r"was\s+(?:synthesized|prepared|calcined|heated|annealed)",
    r"were\s+(?:synthesized|prepared|calcined|heated|annealed)",
    r"(?:precursor|melamine|urea|dicyandiamide|DCDA)\s+(?:was|were|is)",
    r"(?:tube|muffle)\s+furnace",
    r"crucible",
    r"(?:heated|calcined|annealed)\s+(?:at|to)\s+\d+\s*[°℃]",
    r"\d+\s*[°℃]C?\s+for\s+\d+",
    r"(?:N2|Ar|air|NH3)\s+atmosphere",
    r"under\s+(?:N2|Ar|air|NH3|nitrogen|argon)",
    r"heating\s+rate\s+of\s+\d+",
    r"polycondensation",
    r"thermal\s+(?:polymerization|condensation)",
    r"hydrothermal|solvothermal|autoclave",
]

# What a header of another subject says behind its number.
AFTER_SYNTHESIS = [
    r"(?:Physicochemical\s+|Sample\s+|Structural\s+|Material\s+)?Characterizations?\b",
    r"Instruments?\b",
    r"Measurements?\b",
    r"Photocatalytic\b",
    r"Photocatalysis\b",
    r"Photoelectrochemical\b",
    r"Electrochemical\b",
    r"Hydrogen\s+(?:evolution|production)",
    r"Photo-?degradation\b",
    r"(?:Density.functional|DFT|Computational|Theoretical)\s+(?:theory|calculation|detail|method|studie)",
    r"Photocurrent\b",
    r"Impedance\b",
    r"Catalytic\s+(?:activity|performance|test)",
    r"(?:Quantum\s+)?(?:Efficiency|yield)\s+(?:measurement|test)",
    r"(?:Water\s+)?(?:Contact\s+angle|Wettability)\b",
    r"Nitrogen\s+(?:fixation|reduction)\s+(?:measurement|test|experiment)",
]

# What a page of an error or of a paywall says.
ERROR_PAGE = [
    "javascript is disabled",
    "please turn javascript on",
    "request id:",
    "access denied",
    "this content is not available",
    "cookie policy",
    "subscribe to read",
]
