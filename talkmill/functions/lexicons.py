"""Phrase lists, patterns and thresholds that results depend on."""

AI_ASSISTANT_PHRASES = (
    "as an ai", "as a language model", "i'm an ai", "i am an ai", "i don't have personal", "i do not have personal",
    "i cannot provide", "i can't provide", "it's important to note", "it is important to note", "it's worth noting",
    "here are some", "here's a list", "in conclusion", "i hope this helps", "let me know if you have any", "feel free to ask",
    "certainly!", "of course!", "great question", "i'd be happy to help", "i'm here to help", "as your assistant",
    "please note that", "there are several", "firstly,", "secondly,", "furthermore,", "in summary", "to summarize",
    "keep in mind that", "disclaimer", "consult a professional", "consult a doctor", "seek professional",
    "i apologize for any confusion", "step 1", "step-by-step",
)
FACTUAL_QA_MARKERS = (
    "the capital of", "was invented by", "is defined as", "refers to the", "according to the", "in the year", "the formula for",
    "the theory of", "is a type of", "consists of the following", "the process by which", "photosynthesis", "mitochondria",
    "world war", "the periodic table",
)
INSTRUCTION_MARKERS = (
    "write an essay", "summarize the following", "translate the following", "rewrite the", "generate a list", "explain in detail",
    "act as a", "you are a helpful", "follow these instructions", "output the following", "in bullet points", "in json", "step by step",
)
CODE_PATTERNS = (
    r"```", r"\bdef\s+\w+\s*\(", r"\bclass\s+[A-Z]\w*\s*[:(]", r"\b(?:import|from)\s+\w+\s+(?:import|as)\b",
    r"\b(?:console\.log|System\.out|printf|puts)\s*\(", r"\bprint\s*\([\"'\w]", r"</\w+>|<\w+\s*/>", r"\bSELECT\b.+\bFROM\b",
    r"#include\s*<", r"\b(?:npm|pip|apt|brew|cargo)\s+install\b", r"\bgit\s+(?:commit|clone|push|checkout)\b",
    r"=>\s*[\{\(]|\bfunction\s*\(", r"\}\s*\)\s*;|\{\s*$", r"^\s*(?:\$|>>>|sudo)\s+\S", r"\bfor\s*\(\s*\w+\s*=|\bwhile\s*\(",
)
MATH_PATTERNS = (
    r"\bsolve for\b", r"\bderivative of\b", r"\bintegral of\b", r"\bsquare root of\b", r"\b\w+'?s? theorem\b",
    r"\bcalculate the \w+ of\b", r"\b[a-z]\s*=\s*-?\d", r"\bsum of the\b", r"\bequation\b", r"\b\d+\s*[\+\-\*/x]\s*\d+\s*=",
    r"\bmultiply(?: \w+)? by\b", r"\bdivide(?:d)? by\b",
)
LIST_LINE = r"(?m)^\s*(?:[-*•]|\d+[.)])\s+"
AI_STYLE_MARKERS = (
    "as an ai", "as a language model", "i'm an ai", "it's important to", "i hope this helps", "let me know if", "feel free to",
    "here are some", "in conclusion", "i'd be happy to", "certainly!", "great question", "i don't have personal", "step 1",
    "furthermore", "in summary",
)
CONFIDENT_FACTS = (
    "was invented by", "was created by", "is located in", "the capital of", "the answer is", "developed by", "founded in", "according to",
)
GRACEFUL_IGNORANCE = (
    "no idea", "not sure", "dunno", "don't know", "no clue", "beats me", "never heard", "couldn't tell you", "?",
)
DIMENSION_WEIGHTS = {
    "naturalness": 1.5, "brevity": 1.0, "relevance": 1.5, "emotional_appropriateness": 1.0, "continuation": 1.0,
    "non_repetition": 1.0, "no_unnecessary_facts": 0.75, "non_assistant_style": 1.25,
}
HARD_FLOORS = {"naturalness": 2.0, "relevance": 2.0, "non_assistant_style": 2.0}
NEGATIVE_CUES = (
    "tired", "sad", "bad", "awful", "brutal", "stressed", "sucks", "hate", "worried", "lonely", "annoyed", "exhausted", "rough",
)
POSITIVE_CUES = ("great", "good", "happy", "excited", "awesome", "love", "amazing", "stoked", "nice", "fun", "got the job", "celebrat")
EMPATHY = ("oof", "damn", "rough", "sorry", "that sucks", "ugh", "yikes", "hang in there", "sending", "aw", "ouch")
CELEBRATION = ("congrats", "nice", "yes!", "amazing", "awesome", "let's go", "so happy", "hyped", "love that", "great")
BACKCHANNEL = (
    "yeah", "oh", "mm", "haha", "lol", "right", "true", "same", "fair", "wow", "damn", "nice", "for real", "makes sense", "gotcha",
)
TURN_FLAGS = {
    "has_greeting": r"(?i)\b(hi|hey|hello|yo|hiya|heya|howdy|morning|evening|sup)\b",
    "has_goodbye": r"(?i)\b(bye|goodbye|see ya|see you|later|night|goodnight|gtg|heading off|i'm off|take care|catch you)\b",
    "has_thanks": r"(?i)\b(thanks|thank you|thx|ty|cheers|appreciate)\b",
    "has_apology": r"(?i)\b(sorry|apolog|my bad|my fault)\b",
    "has_correction": r"(?i)\b(actually|no wait|i meant|not quite|scratch that|correction|wrong)\b",
    "has_negation": r"(?i)\b(not|no|never|didn't|don't|can't|won't|isn't|wasn't)\b",
    "repeated_punct": r"!!|\?\?|\.\.",
}
MEMORY_SLOTS = {
    "name": r"\b(?:i'?m|my name'?s|call me|name is)\s+([A-Z][a-z]{1,14})\b",
    "pet_name": r"(?i)\b(?:my|our)\s+(?:dog|cat|puppy|kitten|rabbit|parrot|bird)(?:'s| is)?\s+(?:called|named|is)\s+([a-z]{2,14})\b",
    "pet_type": r"(?i)\b(?:i|we)\s+(?:have|got|adopted)\s+a\s+(dog|cat|puppy|kitten|rabbit|parrot|hamster|bird)\b",
    "location": r"\bi\s+live\s+in\s+([A-Za-z][a-z]{2,18})\b",
}
#: A job must not be a question, which needs a look ahead; states that follow "i'm a" are no jobs.
JOB = r"(?i)\bi(?:'m| am)\s+a[n]?\s+([a-z]{3,18}(?:\s[a-z]{3,12})?)\b(?!\s*\?)"
NOT_JOBS = (
    "bit", "little", "lot", "mess", "wreck", "fan", "big", "huge", "real", "good", "bad", "tired", "sorry", "idiot", "loser",
    "morning", "night",
)
TOPIC_KEYWORDS = {
    "work": ("work", "job", "boss", "meeting", "shift", "office", "deadline", "coworker"),
    "school": ("school", "class", "exam", "homework", "teacher", "assignment", "college"),
    "food": ("food", "eat", "dinner", "lunch", "breakfast", "hungry", "cook", "pizza", "coffee"),
    "sleep": ("sleep", "tired", "nap", "bed", "insomnia", "exhausted", "awake"),
    "music": ("music", "song", "album", "band", "playlist", "concert", "guitar"),
    "games": ("game", "gaming", "playstation", "xbox", "steam", "level", "match"),
    "movies": ("movie", "film", "show", "series", "netflix", "episode", "watched"),
    "exercise": ("gym", "run", "workout", "walk", "lift", "yoga", "swim"),
    "friends": ("friend", "buddy", "hang out", "party", "roommate"),
    "family": ("mom", "dad", "sister", "brother", "family", "parents", "cousin"),
    "weather": ("weather", "rain", "snow", "sunny", "cold", "hot", "storm"),
    "plans": ("weekend", "tomorrow", "tonight", "plan", "trip", "vacation", "later"),
    "mood": ("sad", "happy", "excited", "bored", "stressed", "anxious", "annoyed", "great"),
}
MOOD_WORDS = {
    "tired": ("tired", "exhausted", "sleepy", "drained", "wiped"),
    "sad": ("sad", "down", "bummed", "upset", "lonely"),
    "stressed": ("stressed", "anxious", "overwhelmed", "swamped", "brutal"),
    "happy": ("happy", "great", "awesome", "amazing", "stoked", "excited"),
    "bored": ("bored", "boring", "nothing to do", "meh"),
    "annoyed": ("annoyed", "angry", "mad", "frustrated", "pissed"),
}
BOILERPLATE = r"(?i)\b(as an ai|as a language model|i'?m an ai|i cannot|i can't assist|how can i help|is there anything else|let me know if)\b"
SPECIAL_TOKEN = r"<\|[a-z_0-9]+\|>"
