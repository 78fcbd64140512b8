"""Default vocabularies, weights and thresholds. All of them are parameters of the operators that use them."""

from __future__ import annotations

# --- Fixed values: results depend on exactly these terms, in this order. ---------------------------------------

#: Term -> canonical form.
SLANG = {
    "oxy": "oxycodone", "oxys": "oxycodone", "percs": "percocet", "perc": "percocet", "vikes": "vicodin", "vics": "vicodin",
    "subs": "suboxone", "subbies": "suboxone", "done": "methadone", "dones": "methadone", "fent": "fentanyl",
    "fetty": "fentanyl", "china white": "fentanyl", "h": "heroin", "boy": "heroin", "black tar": "heroin", "dope": "heroin",
    "smack": "heroin", "junk": "heroin", "bars": "xanax", "xannies": "xanax", "benzos": "benzodiazepine",
    "k-pins": "klonopin", "pins": "klonopin", "meth": "methamphetamine", "ice": "methamphetamine",
    "crystal": "methamphetamine", "tweak": "methamphetamine", "addys": "adderall", "addy": "adderall", "coke": "cocaine",
    "blow": "cocaine", "crack": "cocaine", "snow": "cocaine", "booze": "alcohol", "liquor": "alcohol", "sauce": "alcohol",
    "weed": "cannabis", "pot": "cannabis", "bud": "cannabis", "mary jane": "cannabis", "nodding": "opioid intoxication",
    "fiending": "craving", "jonesing": "withdrawal", "dope sick": "withdrawal",
}

#: Category -> phrases that are looked for as substrings.
DISTRESS_SIGNALS = {
    "relapse": ["relapsed", "relapsing", "fell off", "slipped", "using again", "back on", "couldn't stay clean"],
    "craving": ["fiending", "jonesing", "craving", "need it", "gotta have", "can't stop thinking about"],
    "withdrawal": ["dope sick", "withdrawals", "withdrawing", "kicking", "sick", "sweating", "shaking", "can't sleep", "vomiting"],
    "desperation": ["running out", "out of", "need more", "last one", "scraping", "desperate", "please help"],
    "overdose": ["od'd", "overdosed", "overdose", "too much", "almost died", "narcan", "naloxone", "revived"],
    "hopelessness": ["can't quit", "never gonna stop", "hopeless", "gave up", "no point", "done trying"],
}

SUBSTANCE_WEIGHTS = {
    "fentanyl": 1.00, "heroin": 1.00, "opioid intoxication": 1.00, "withdrawal": 0.90, "methamphetamine": 0.90,
    "oxycodone": 0.85, "percocet": 0.85, "hydrocodone": 0.80, "cocaine": 0.80, "methadone": 0.75, "craving": 0.75,
    "xanax": 0.70, "benzodiazepine": 0.70, "suboxone": 0.60, "adderall": 0.50, "alcohol": 0.50, "cannabis": 0.20,
}
DEFAULT_SUBSTANCE_WEIGHT = 0.40

DISTRESS_WEIGHTS = {"overdose": 1.00, "relapse": 0.90, "withdrawal": 0.85, "desperation": 0.80, "hopelessness": 0.75, "craving": 0.65}
DEFAULT_DISTRESS_WEIGHT = 0.50

#: Words of a topic profile that tell of harm.
HARM_TERMS = (
    "overdos", "overdose", "withdraw", "withdrawal", "seizur", "seizure", "needle", "inject", "death", "die", "died",
    "dying", "hospital", "uncons", "unconscious", "vomit", "convuls", "respiratori", "naloxon", "narcan", "resuscit",
)

#: A mention that one of these precedes or accompanies weighs less.
NEGATION = r"\b(never|not|no longer|quit|stopped|clean from|sober from|recovering from|off of|free from)\b"
PAST = r"\b(used to|back when|years ago|in the past|before i got clean|when i was using)\b"

URGENCY = (
    r"\b(help me|i need help|please help|someone help)\b",
    r"\b(going to die|might die|could die|scared to die)\b",
    r"\b(last resort|nowhere to turn|no one to call)\b",
    r"\b(can't take it|can't do this|done with this)\b",
)
ESCALATION = (
    r"\b(need more|taking more|upping my dose|more than prescribed)\b",
    r"\b(running out|almost out|last few|scraped together)\b",
    r"\b(doctor shopping|multiple doctors|pharmacy hopping)\b",
)

#: Group -> (weight, patterns).
BEHAVIOURS = {
    "route_of_administration": (0.95, (
        r"\b(shooting up|shooting it|IV|intravenous|injecting)\b",
        r"\b(snorting|snorted|insufflation|railing|rails)\b",
        r"\b(smoking it|hitting the pipe|freebasing)\b",
        r"\b(plugging|rectal|boofing)\b",
    )),
    "dose_manipulation": (0.85, (
        r"\b(crushing|chewing|dissolving).{0,20}(pill|tab|mg)\b",
        r"\b(more than prescribed|double.{0,10}dose|extra.{0,10}dose)\b",
        r"\b(mixing|combining|stacking).{0,30}(with|and)\b",
    )),
    "procurement": (0.90, (
        r"\b(where can i (get|find|buy)|how do i (get|find|buy))\b",
        r"\b(connect|plug|dealer|hook me up)\b",
        r"\b(dark web|darknet)\b",
        r"\b(pressed|counterfeit|fake).{0,15}(pill|tab|bar)\b",
    )),
    "concealment": (0.80, (
        r"\b(hide|hiding|conceal|secret|without (them|anyone) knowing)\b",
        r"\b(fake|empty).{0,10}(prescription|script|bottle)\b",
        r"\b(beat.{0,10}test|pass.{0,10}drug test|clean.{0,10}piss)\b",
    )),
    "social_disruption": (0.75, (
        r"\b(lost my job|fired|can't work|missed work).{0,30}(because|due to)\b",
        r"\b(kicked out|evicted|homeless).{0,30}(because|due to|over)\b",
        r"\b(family.{0,20}(left|gave up|done with me))\b",
    )),
}

#: Product name -> category; the first that occurs in a name decides.
PRODUCTS = {
    "oxycodone": "opioid", "hydrocodone": "opioid", "oxycontin": "opioid", "vicodin": "opioid", "percocet": "opioid",
    "buprenorphine": "opioid", "suboxone": "opioid", "methadone": "opioid", "tramadol": "opioid", "codeine": "opioid",
    "fentanyl": "opioid", "morphine": "opioid", "heroin": "opioid", "alprazolam": "benzo", "xanax": "benzo",
    "diazepam": "benzo", "valium": "benzo", "clonazepam": "benzo", "klonopin": "benzo", "lorazepam": "benzo",
    "ativan": "benzo", "amphetamine": "stimulant", "adderall": "stimulant", "methamphetamine": "stimulant",
    "cocaine": "stimulant", "methylphenidate": "stimulant", "ritalin": "stimulant", "vyvanse": "stimulant",
    "naltrexone": "alcohol", "acamprosate": "alcohol", "disulfiram": "alcohol", "gabapentin": "gabapentin",
    "pregabalin": "gabapentin",
}
PRODUCT_ALIASES = {"heroin": "opioid", "methamphetamine": "stimulant"}

CONDITIONS = (
    "opiate dependence", "opioid dependence", "alcohol dependence", "alcohol use disorder", "drug dependence",
    "substance abuse", "anxiety and stress", "pain", "chronic pain", "adhd", "depression",
)

#: Folder name of experience reports -> category: exact, else the first that occurs in the name.
FOLDERS = {
    "heroin": "opioid", "opioids": "opioid", "oxycodone": "opioid", "hydrocodone": "opioid", "oxycontin": "opioid",
    "vicodin": "opioid", "buprenorphine": "opioid", "suboxone": "opioid", "methadone": "opioid", "tramadol": "opioid",
    "codeine": "opioid", "fentanyl": "opioid", "morphine": "opioid", "opium": "opioid", "poppies": "opioid",
    "poppy": "opioid", "hydromorphone": "opioid", "tylenol 3": "opioid", "percocet": "opioid", "demerol": "opioid",
    "amphetamine": "stimulant", "amphetamines": "stimulant", "methamphetamine": "stimulant", "methaphetamine": "stimulant",
    "cocaine": "stimulant", "crack": "stimulant", "crack cocaine": "stimulant", "methylphenidate": "stimulant",
    "ritalin": "stimulant", "dextroamphetamine": "stimulant", "dexedrine": "stimulant", "adderall": "stimulant",
    "vyvanse": "stimulant", "ephedrine": "stimulant", "ephedra": "stimulant", "methcathinone": "stimulant",
    "clenbuterol hcl": "stimulant", "alcohol": "alcohol", "absinthe": "alcohol", "alprazolam": "benzo", "xanax": "benzo",
    "diazepam": "benzo", "valium": "benzo", "clonazepam": "benzo", "lorazepam": "benzo", "temazepam": "benzo",
    "rohypnol": "benzo", "benzodiazepines": "benzo", "diazepam (valium)": "benzo", "alprazolam (xanax)": "benzo",
    "ghb": "other", "gbl": "other", "1,4-butanediol": "other", "ketamine": "other", "dxm": "other", "pcp": "other",
    "cannabis": "other", "marijuana": "other", "hash": "other", "hashish": "other",
}

HIGH_RISK_PHRASES = (
    "addicted", "addiction", "dependent", "dependence", "withdrawal", "withdrawals", "relapse", "relapsed", "can't stop",
    "cannot stop", "need more", "running out", "doctor shopping", "crushing", "snorting", "shooting up", "overdose",
    "od'd", "blacked out",
)
DISTRESS_PHRASES = (
    "anxiety", "depressed", "suicidal", "hopeless", "desperate", "scared", "terrified", "shaking", "sweating", "nausea",
    "vomiting", "craving",
)

KNOWN_SLANG = {
    "oxy": "opioid", "oxys": "opioid", "percs": "opioid", "vikes": "opioid", "subs": "opioid", "subbies": "opioid",
    "done": "opioid", "bars": "benzo", "xannies": "benzo", "benzos": "benzo", "addys": "stimulant", "speed": "stimulant",
    "gabas": "gabapentin", "gabbies": "gabapentin",
}
STOPWORDS = (
    "the", "and", "for", "was", "this", "that", "with", "have", "been", "from", "they", "are", "but", "not", "you", "all",
    "when", "can", "just", "like", "has",
)

#: Indicator of the official counts -> substance.
INDICATORS = {
    "Opioids (T40.1-T40.4,T40.6)": "opioid",
    "Heroin (T40.1)": "opioid",
    "Synthetic opioids (T40.4)": "opioid",
    "Natural & semi-synthetic opioids (T40.2)": "opioid",
    "Methadone (T40.3)": "opioid",
    "Natural & semi-synthetic opioids, incl. methadone (T40.2, T40.3)": "opioid",
    "Natural, semi-synthetic, & synthetic opioids, incl. methadone (T40.2-T40.4)": "opioid",
    "Cocaine (T40.5)": "cocaine",
    "Psychostimulants with abuse potential (T43.6)": "stimulant",
    "Stimulants (T43.6)": "stimulant",
    "Alcohol-induced causes": "alcohol",
}
ICD10 = {
    "T40.0": "opioid", "T40.1": "opioid", "T40.2": "opioid", "T40.3": "opioid", "T40.4": "opioid", "T40.5": "cocaine",
    "T40.6": "opioid", "T43.6": "stimulant", "T51.0": "alcohol", "T51.1": "alcohol", "T51.9": "alcohol",
}

#: Public yearly rates from 2015 on: past-year disorder in percent, and deaths per 100,000.
PREVALENCE = {
    "alcohol": (7.8, 8.2, 8.2, 8.1, 8.3, 9.4, 9.9, 10.1),
    "opioid": (1.5, 1.7, 1.7, 1.6, 1.6, 1.8, 1.9, 2.0),
    "cocaine": (0.4, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5),
    "stimulant": (0.4, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
}
DEATH_RATES = {
    "opioid": (10.4, 13.3, 14.9, 14.6, 14.9, 21.4, 24.7, 24.4),
    "cocaine": (2.4, 3.5, 4.3, 4.5, 4.5, 5.2, 5.9, 6.1),
    "stimulant": (1.2, 1.7, 2.2, 2.9, 3.9, 5.6, 6.8, 7.4),
    "alcohol": (8.2, 8.6, 9.1, 9.5, 10.0, 13.1, 13.7, 14.1),
}
FIRST_RATE_YEAR = 2015

TOPICS = ("relapse", "withdrawal", "craving", "harm_reduction", "recovery", "procurement", "overdose", "hopelessness")
TOPIC_ANCHORS = {
    "relapse": "I relapsed and started using again after being clean",
    "withdrawal": "I'm going through withdrawals, dope sick, shaking and sweating",
    "craving": "I can't stop thinking about it, the cravings are overwhelming",
    "harm_reduction": "how to use more safely, reduce risk, naloxone and clean supplies",
    "recovery": "staying sober, going to meetings, proud of my sobriety",
    "procurement": "where to get it, finding a dealer, buying drugs",
    "overdose": "I overdosed, nearly died, revived with narcan",
    "hopelessness": "I give up, nothing will ever change, no point trying",
}

#: Sources of the vote -> their weights, by which optional sources are there.
VOTE_WEIGHTS = {
    frozenset({"llm"}): {"rule": 0.25, "embedding": 0.35, "llm": 0.40},
    frozenset(): {"rule": 0.35, "embedding": 0.65},
    frozenset({"llm", "finetuned"}): {"rule": 0.20, "embedding": 0.30, "llm": 0.40, "finetuned": 0.10},
    frozenset({"finetuned"}): {"rule": 0.30, "embedding": 0.60, "finetuned": 0.10},
}

# --- End of the fixed values. ----------------------------------------------------------------------------------

RISKS = ("low", "medium", "high")
LAYER_WEIGHTS = {"substance": 0.30, "distress": 0.35, "behavior": 0.35}
VOTE_CUTS = (0.5, 1.5)
