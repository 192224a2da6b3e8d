"""Values a study may need as they are; every operator takes its own lists as parameters."""

# Trailing words that name a salt or form of a compound.
SALT_WORDS = [
    "hydrochloride", "hydrobromide", "sodium", "potassium", "calcium", "magnesium", "mesylate", "maleate",
    "fumarate", "tartrate", "citrate", "phosphate", "sulfate", "succinate", "acetate", "lactate", "nitrate",
    "besylate", "tosylate", "ditosylate", "isethionate", "gluconate", "palmitate", "valerate", "estolate",
    "pamoate", "tromethamine", "meglumine", "dimeglumine", "olamine", "hemifumarate", "polistirex",
    "monohydrate", "dimethyl sulfoxide", "sodium glycinate", "complex",
]

# Name parts that decide the exclusion code of an unresolved record, first list first.
UNRESOLVED_TOKENS = {
    "MIXTURE_OR_COMBINATION": ["ivermectin", "simethicone-cellulose"],
    "BIOLOGIC_OR_MACROMOLECULE": [
        "interferon", "toxin", "filgrastim", "somatropin", "pancrelipase", "urokinase", "pegcetacoplan",
        "defibrotide", "protein", "secretin", "dermatan", "protamine", "enoxaparin", "dalteparin", "porfimer",
        "glatiramer", "sargramostim", "oprelvekin", "etanercept", "anakinra", "palifermin", "abatacept",
        "rilonacept", "romiplostim", "casimersen", "eteplirsen", "givosiran", "golodirsen", "inclisiran",
        "lumasiran", "nusinersen", "patisiran", "viltolarsen",
    ],
    "POLYMER_OR_UNRESOLVED_INORGANIC": [
        "poly", "ferumox", "sevelamer", "hetastarch", "technetium", "radium", "patiromer", "sucralfate",
    ],
}
UNRESOLVED_DEFAULT = "IDENTITY_UNRESOLVED"

# Spellings of outcome categories and what they count as.
CATEGORY_SPELLINGS = {"vMOST-DILI-concern": "vMost-DILI-concern", "vNo-DILI-Concern": "vNo-DILI-concern"}
POSITIVE_CATEGORIES = ["vMost-DILI-concern", "vLess-DILI-concern"]
NEGATIVE_CATEGORIES = ["vNo-DILI-concern"]

# Limits of the eligibility cascade.
MAX_WEIGHT = 2000.0
MAX_HEAVY_ATOMS = 160
PEPTIDE_MIN_AMIDES = 6
PEPTIDE_MIN_WEIGHT = 700.0

# Flags that say how a curated row was decided.
FLAG_METAL = "METAL_WITH_MULTIPLE_ORGANIC_FRAGMENTS"
FLAG_PEPTIDE = "PEPTIDE_OR_PEPTIDOMIMETIC_RULE"
FLAG_SALT = "SALT_OR_MULTICOMPONENT_SOURCE"
FLAG_EQUIVALENT = "PUBCHEM_ACTIVE_MOIETY_EQUIVALENCE_CONFIRMED"
FLAG_NOT_EQUIVALENT = "EXACT_PRODUCT_PARENT_RETAINED_NON_EQUIVALENT_SUFFIX_FALLBACK"
FLAG_OVERRIDE = "MANUAL_ACTIVE_MOIETY_OVERRIDE"
FLAG_MANUAL = "MANUAL_REVIEW:"
REVIEW_STATUS = "rules-applied-pending-independent-review"
