"""Patterns and word lists that facts are read with."""

# They decide which facts are found and must stay as they are.
AMOUNT = r"([0-9]{2,3}(?:,[0-9]{3})?|[0-9]{2,3})"
MONEY = r"\$\s*" + AMOUNT + r"\s*(k)?"
MONEY_RANGE = MONEY + r"\s*(?:-|–|—|to)\s*\$?\s*" + AMOUNT + r"\s*(k)?"
COMPETITIVE = r"\bcompetitive (?:salary|compensation|pay)\b"
HYBRID = r"\bhybrid\b"
ONSITE = r"\b(?:on[- ]site|in[- ]office)\b"
REMOTE = r"\bremote\b"
US_ONLY = r"(?:us|u\.s\.|united states)[ -]only|must (?:reside|be based) in (?:the )?(?:us|u\.s\.|united states)"
WORLDWIDE = r"worldwide|anywhere in the world|international candidates (?:are )?(?:welcome|eligible)"
COUNTRY = r"(?:may reside in|must reside in|must be based in|candidates? (?:located|based) in)\s+([A-Z][A-Za-z ]{2,30})"
TIME_ZONE = r"\b(?:EST|EDT|CST|CDT|MST|MDT|PST|PDT|UTC[+-]\d{1,2})\b"
VISA_YES = r"visa sponsorship (?:is )?(?:available|provided)"
VISA_NO = r"no visa sponsorship|unable to sponsor"
RELOCATION_YES = r"relocation (?:is )?(?:available|provided)"
RELOCATION_MUST = r"relocation required"
RELOCATION_NO = r"no relocation"
EMPLOYER_OF_RECORD = r"employer of record|\bEOR\b|\bDeel\b|\bOyster\b"
PLACE = r"remote|hybrid|on[- ]site|resid|country|time\s*zone|visa|relocat|employer of record|\bEOR\b|Deel|Oyster"
TRAVEL = r"travel|on[- ]site|onsite|conference|retreat|kickoff"
PERCENT = r"(\d{1,3})\s*%"
NO_TRAVEL = r"\b(?:no travel|travel (?:is )?not required|zero travel)\b"
FIELD_TRAVEL = r"field travel|territory travel"
CUSTOMER_TRAVEL = r"customer|client"
COMPANY_EVENT = r"retreat|kickoff|team gathering|company meeting"
CONFERENCE = r"conference"
FREQUENCY = r"\b(weekly|monthly|quarterly|annually|annual|occasionally|occasional|rare|infrequent|frequent|recurring)\b"
MANDATORY = r"required|must|will travel|travel is expected"
OPTIONAL = r"optional"
BOTH_SCOPES = r"domestic and international|international and domestic"
REQUIREMENT = r"\brequired\b|\bmust have\b|\bpreferred\b|\bideal(?:ly)?\b|nice to have|\d+(?:\s*(?:-|–|—|to)\s*\d+)?\+?\s+years? of experience"
STRENGTHS = [("NICE_TO_HAVE", r"nice to have"), ("PREFERRED", r"\bpreferred\b"), ("IDEAL", r"\bideal(?:ly)?\b"), ("REQUIRED", r"\brequired\b|\bmust have\b")]
YEARS_RANGE = r"(\d+)\s*(?:-|–|—|to)\s*(\d+)(\+)?\s+years?"
YEARS = r"(\d+)(\+)?\s+years?"
CATEGORIES = [
    ("TRAVEL", r"travel"),
    ("LOCATION", r"location|reside|based in|time\s*zone"),
    ("EDUCATION", r"degree|bachelor|master"),
    ("CERTIFICATION", r"certif"),
    ("LANGUAGE", r"language|fluent|bilingual"),
    ("TOOL", r"software|platform|tool|salesforce|gainsight|hubspot"),
    ("TECHNICAL_KNOWLEDGE", r"technical|api|integration|data|analytics"),
    ("INDUSTRY", r"industry|saas|fintech|healthcare"),
    ("EXPERIENCE", r"experience|years?"),
]
EXPLICIT_ABSENCE = r"\b(?:does not|do not|will not|not responsible|not own|no responsibility|excluded|excluding|handled by|owned by|outside (?:the )?role|not part of)\b"
RECURRING = r"weekly|monthly|frequent|recurring"
