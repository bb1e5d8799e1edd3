"""Word lists and patterns that product names are read by."""

from __future__ import annotations

# Fixed values, alphabetical within each list.
ACRONYM_BRANDS = "AIG".split()
ADULT = "ADULT ADULTS".split()
AGE = "ADULT ADULTS BABY CHILDREN INFANT INFANTS KID KIDS PAEDIATRIC PEDIATRIC".split()
BABY_FOOD = "APTAMIL BEBELAC BEBEJUNIOR CERELAC FEH HERO MILK NAN NIDO S26".split()
BABY_FORMULA_MODIFIERS = "AC AR COMFORT DIGEST EC EXPERT FL HA IT LF OPTIPRO PRE PRO SENSITIVE".split()
BRAND_QUALIFIERS = (
    "ALKALINE AMOUN ANTI CAFFEINE DA DS EFFOX EMOLLIENT ESOMEPRAZOLE EXTRA FORET FORTE GROWTH HAIR INFANT INFANTILE"
    " INFANTS INFINITY KID KIDS LONG OPHTALMIC OPHTIOLE ORL PAEDIATRIC PEDIATRIC RICH SURACTIVE"
).split()
CHEMICALS = "ADOL CALCIUM CETAL DOLIPRANE IRON MAGNESIUM PANADOL PARAMOL POTASSIUM SODIUM ZINC".split()
COLORS = "BLACK BLUE BROWN GOLD GREEN GREY PINK PURPLE RED SILVER WHITE YELLOW".split()
CONNECTORS = "AND OF THE WITH".split()
COSMETIC = "BODY CONCEALER COSMETIC CREAM DEODORANT DOUCHE EMULGEL GEL HAIR LOTION MASK MOUTH MOUTHWASH OIL SERUM SHAMPOO SOAP SPRAY SUN TONER WASH".split()
DEVICES = "BANDAGE CANULA CONDOM CONDOMS LANCET LANCETS NEBULIZER NEEDLE NEEDLES PATCH PATCHES STRIP STRIPS SYRINGE SYRINGES".split()
FLAVORS = "APPLE BANANA BERRY CHERRY CHOCOLATE CLOVE COLA GINGER GRAPE LEMON MANGO MINT ORANGE PINEAPPLE RASPBERRY STRAWBERRY VANILLA".split()
FLAVOR_MARKS = "BERRY CHOCOLATE GREEN LEMON MINT ORANGE STRAWBERRY VANILLA".split()
FORM_PREFIXES = (
    "CLEANSER CREAM DOUCHE DROPS EAR EMULGEL EMULSION ENEMA EYE FEMININE GEL INFUSION INH INHALER INJECTION INTIMATE"
    " LOTION MASSAGE MOUTHWASH NASAL OIL OINT OINTMENT OPHTALMIC ORAL ORL POWDER SERUM SHAMPOO SOAP SOLN SOLUTION SPRAY"
    " SPRAYS SUSP SUSPENSION SYP SYRP SYRUP TOPICAL WASH"
).split()
FORM_WORDS = (
    "AMP AMPOULE AMPOULES AMPS BOTTLES CAP CAPS CAPSULE CAPSULES CARTRIDGE CARTRIDGES DOSES DROP DROPS EFF EFFERVESCENT"
    " FILM FILMS GUMMIES LOZENGES ORODISSOLVABLE PACKETS PEN PENS PIECE PIECES SACH SACHET SACHETS SUPP SUPPS TAB TABLET"
    " TABLETS TABS VIAL VIALS"
).split()
#: The first of these that a name holds gives its form.
FORM_ORDER = (
    "VIAL VIALS AMPOULES AMPOULE AMP AMPS PENS PEN CARTRIDGES CARTIRIDGES CARTRIDGE SPRAY SPRAYS METERED SYRUP SYRP SYP"
    " SUSP OINTMENT OINT DROPS DROP EYE OPHTALMIC GEL CREAM POWDER SHAMPOO CLEANSER WASH SOLUTION SUPPS SUPP TABLETS"
    " TABLET TABS TAB CAPSULES CAPSULE CAPS CAP DOSES"
).split()
FORM_NAMES = {
    "TAB": "TAB TABLET TABLETS TABS",
    "CAP": "CAP CAPS CAPSULE CAPSULES",
    "SPRAY": "DOSES METERED SPRAY SPRAYS",
    "EYE": "DROP DROPS EYE OPHTHALMIC",
    "OINT": "OINT OINTMENT",
    "VIAL": "VIAL VIALS",
    "AMP": "AMP AMPOULE AMPOULES AMPS",
    "PEN": "PEN PENS",
    "CARTRIDGE": "CARTIRIDGES CARTRIDGE CARTRIDGES",
    "SUPP": "SUPP SUPPS",
    "SYRUP": "SYP SYRP",
}
INFUSION = "AMP AMPS I I/V INFUSION INJ INJECTION IV V VIAL".split()
LIQUID_DOSE_FORMS = "AMP ORL SOLUTION SUSP SYRUP VIAL".split()
LIQUID_FORMS = "ORL SOLUTION SUSP SYRUP".split()
MANUFACTURERS = (
    "ADWIA AMOUN AMRIYA BAYER DELTA EIPICO EVA GLAXO GSK HIKMA INAD JULPHAR KAHIRA MARCYRL MASH MEMPHIS MEPACO MERCK"
    " NOVARTIS OCTOBER ORA ORCHIDIA PFIZER PHARCO ROCHE SANDOZ SANOFI SEDICO SIGMA SPIMACO TEVA"
).split()
MODIFIERS = (
    "ADVANCE CARE COLD COLLEDGE CR D DR ER EVA EXTRA FEMALE FORTE JOINT MACRO MALE MAN MEN MILGA MOUTH MR NASAL NIGHT"
    " PLUS PRONTO R SINUS SR VAGINAL WOMEN XL XR"
).split()
NOISE = "BLUE FACIAL FLAVOR FLAVOUR LIQUID MILK ORS RED WHITE".split()
OCULAR_FORMS = "DROPS EYE OPHTALMIC SOLUTION".split()
ROUTES = "IM IV SC".split()
SOFT_DESCRIPTORS = "ACTIVE ADULT ADULTS ANISE ANTISEPTIC COLD FLU FOLIC JOINT NIGHT ORIGINAL SINUS TOP TRIPLE VAG VAGINAL".split()
SOLID_FORMS = "CAP TAB".split()
STRONG_MODIFIERS = "ADVANCE EXTRA FORTE MAX PLUS SUPER".split()
SUPPLEMENTS = "ASHWAGANDHA BIOTIN CALCIUM CENTRUM COLLAGEN D3 FEROGLOBIN GLUCOSAMINE OMEGA PERFECTIL PREGNACARE VITAMIN VITAMINS ZINC".split()
VITAMINS = "B1 B12 B2 B6 D3".split()

# Fixed values of the lexical rules.
TOKEN_NAMES = {
    "AMP": "AMPOULE",
    "AMPS": "AMPOULE",
    "BAG": "BAGS",
    "CAP": "CAPSULE",
    "CAPS": "CAPSULE",
    "CAPSULES": "CAPSULE",
    "DROP": "DROPS",
    "DRP": "DROPS",
    "FILT": "FILTER",
    "FILTERS": "FILTER",
    "FL": "LF",
    "FRUIT": "FRUITS",
    "INJ": "INJECTION",
    "SUSP": "SUSPENSION",
    "SYP": "SYRUP",
    "TAB": "TABLET",
    "TABLETS": "TABLET",
    "TABS": "TABLET",
    "VIT": "VITAMIN",
}
CRITICAL_TOKENS = (
    "ADULT ANISE APPLE BABY BAGS CEREAL CHAMOMILE CINNAMON CLOVE CREAM DETOX DROPS EYE FILTER FORTE FRUITS GEL INJECTION"
    " JUNIOR KIDS LEMON LOTION MAX MILK MINT OINTMENT ORANGE PLUS POWDER SHAMPOO SOAP SPRAY STRAWBERRY SYRUP TABLET ULTRA"
    " VANILLA VIAL VITAMIN"
).split()
DISTINGUISHING_TOKENS = "2% ADVANCED EXTRA FORTE JOINT MAX PLUS PRO SUPER ULTRA".split()
CONFLICTS = [
    "ANISE CHAMOMILE CINNAMON CLOVE DETOX MINT".split(),
    "APPLE BANANA CHOCOLATE LEMON ORANGE STRAWBERRY".split(),
    "CREAM GEL LOTION OINTMENT SHAMPOO SOAP".split(),
    "DROPS INJECTION SYRUP VIAL".split(),
]
SAFE_EXTRA_TOKENS = (
    "AMP C CAP CAPS CAPSULE CAPSULES COATED CREAM DROPS F FILM G GEL GM IU L LOTION MCG MG MINI ML OINTMENT SPRAY SUPP"
    " SYRUP TAB TABLET TABLETS TABS VIAL"
).split()
GENERIC_TOKENS = (
    "AMP AMPS ANTISEPTIC BAG BAGS CAP CAPS CAPSULE CAPSULES COUGH CREAM DROP DROPS EFF EYE FILTER FLAVOR FLAVOUR G GEL GM"
    " IMP INJ INJECTION LOTION MCG MG MILK ML O OINTMENT ORAL POWDER SHAMPOO SOAP SOLN SOLUTION SPRAY SYRUP TAB TABLET"
    " TABLETS TABS VIAL"
).split()
ARABIC_MARKS = {
    "APPLE": ["تفاح", "ابل"],
    "AR": ["ايه ار", "اي ار", "ارتجاع"],
    "DOUCHE": ["دش", "غسول", "مهبل"],
    "EFF": ["فوار"],
    "LOTION": ["لوشن", "لوسيون"],
    "ML": ["مل", "مللي", "ميللي"],
    "VAG": ["مهبل", "المهبل", "نسائي"],
    "VAGINAL": ["مهبل", "المهبل", "نسائي"],
}
ARABIC_CALCIUM = "كالسيوم"
ARABIC_TERMS = {
    "MG": "مجم|ملجم|مليجرام|مليجرم",
    "ML": "مل|ملل|مللي|ميللي|مللتر",
    "GM": "جم|جرام|جرم",
    "TAB": "قرص|اقراص|قراص",
    "CAP": "كبسول|كبسولات|كبسوله",
    "AMP": "امبول|امبولات",
    "VIAL": "فيال|فيلات|فيالات",
    "DROPS": "نقط|قطره|قطرات",
    "SPRAY": "بخاخ|بخاخة|سبراي",
    "MILK": "لبن|حليب",
    "SYRUP": "شراب|شرب",
    "CREAM": "كريم|دهان",
    "GEL": "جل|جيل",
    "OINTMENT": "مرهم",
    "AR": r"ايه\s+ار|اي\s+ار|ارتجاع",
}
# Fixed patterns of strengths and packs.
NUMBER = r"\d+(?:\.\d+)?"
DOSAGE = rf"({NUMBER}(?:\s*/\s*{NUMBER})?(?:\s\d{{3}})?)\s*(MG|MCG|I\s*U|IU|%)(?=$|\s)"
MG_PER_ML = rf"({NUMBER})\s*MG\s*/\s*({NUMBER})\s*ML"
COMBINED_MG_PER_ML = rf"({NUMBER})\s*/\s*({NUMBER})\s*MG\s*/\s*({NUMBER})\s*ML"
WEIGHT = rf"({NUMBER})\s*(GM|G)\b"
VOLUME = rf"({NUMBER})\s*ML\b"
PACK = (
    r"(\d+)\s*(?:(?:F\s*C|FC|SCORED|CHEWABLE|EFF|EFFERVESCENT|VAGINAL|VAG|PRE\s*FILLED|PREFILLED|METERED)\s*)?"
    r"(?:TABLETS|TABLET|TABS|TAB|CAPSULES|CAPSULE|CAPS|CAP|SACHETS|SACHET|SACH|AMPOULES|AMPOULE|AMPS|AMP|VIAL|SUPPS|SUPP"
    r"|PIECE|DROPS|PENS|PEN|CARTRIDGES|CARTIRIDGES|CARTRIDGE|SYRINGES|SYRINGE|GUMMIES|GUM|PACKETS|DOSES|METERED)\b"
)
IMPORTED = r"(?i)^[+*.]+\s*IMP|\b(?:IMP|IMPORTED)\b"
