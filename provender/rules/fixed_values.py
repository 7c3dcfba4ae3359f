"""Fixed values of the starter rule pack.

Everything in this file is a value that decides results: word lists, lookup tables and the
category hierarchy. There is no logic here. The three open-ended vocabularies (corrections,
skipped tokens, flavors) hold hundreds of house-specific entries, so only a starter selection is
kept and the full lists are a parameter: ``RuleSet.from_directory`` reads them from tables.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Hierarchy, group -> categories. Order matters (cumulative tag scopes).
HIERARCHY = {
    "Produce": ["Fruit", "Vegetables", "Roots & Tubers", "Produce", "Legumes"],
    "Milk & Dairy": ["Butter", "Cheese", "Milk", "Yogurt", "Milk & Dairy"],
    "Meat": ["Beef", "Chicken", "Eggs", "Pork", "Turkey, Other Poultry", "Meat"],
    "Seafood": ["Fish (Farm-Raised)", "Fish (Wild)", "Seafood"],
    "Bread, Grains & Legumes": [
        "Grain Products",
        "Legumes",
        "Rice",
        "Tree Nuts & Seeds",
        "Bread, Grains & Legumes",
    ],
    "Beverages": ["Beverages"],
    "Meals": ["Meals"],
    "Condiments & Snacks": ["Condiments & Snacks"],
    "Non-Food": ["Non-Food"],
}

# Tags allowed per scope ("All", a group or a category) and column.
TAG_SCOPES = {
    "All": {
        "Flavor/Cut": ["flavored"],
        "Shape": ["concentrate", "cut", "ground", "jerky"],
        "Skin": [],
        "Seed/Bone": [],
        "Processing": [
            "battered",
            "breaded",
            "dried",
            "in oil",
            "in water",
            "in sauce",
            "in puree",
            "puree",
            "seasoned",
            "whipped",
            "in vegetable broth",
            "in vinegar",
            "in liquid",
        ],
        "Cooked/Cleaned": ["cooked"],
        "WG/WGR": ["whole grain rich"],
        "Dietary Concern": [
            "fat free",
            "low fat",
            "low sodium",
            "nonfat",
            "reduced fat",
            "reduced sodium",
            "reduced sugar",
            "reduced calorie",
            "salted",
            "unsalted",
            "no sodium",
            "sugar free",
        ],
        "Additives": ["additives", "no additives", "sweetened", "unsweetened"],
        "Dietary Accommodation": [
            "gluten free",
            "halal",
            "kosher",
            "non-dairy",
            "vegan",
            "vegetarian",
        ],
        "Frozen": ["frozen"],
        "Packaging": ["canned", "jarred", "pouch", "ss"],
        "Commodity": ["commodity"],
    },
    "Meat": {
        "Flavor/Cut": [
            "brisket", "breast", "loin", "shank", "skirt", "steak", "short rib", "t-bone",
            "thigh", "wing", "ham", "round", "butt", "tripe", "marrow bone", "neck", "rib",
            "teres major", "cheek", "belly", "bottom round", "chuck", "knuckle",
            "outside skirt", "oxtail", "pectoral meat", "rack", "shortloin", "shoulder",
            "sirloin top", "tenderloin", "tongue", "sirloin", "tri tip", "feet", "leg",
            "striploin", "loin rib",
        ],
        "Shape": [
            "bacon", "chunk", "diced", "hot dog", "meatball", "nugget", "pepperoni", "patty",
            "salami", "crumble", "guanciale", "mortadella", "pastrami", "nostrano", "bologna",
            "bresaola", "capocollo", "carpaccio", "cotto", "pancetta", "prosciutto",
            "sopressata", "genoa", "iberico",
        ],
        "Skin": ["skin on"],
        "Seed/Bone": ["bone-in"],
        "Processing": ["corned", "stuffed"],
        "Cooked/Cleaned": ["smoked"],
    },
    "Seafood": {
        "Skin": ["tail on", "shell on", "skin on"],
        "Seed/Bone": ["bone-in"],
        "Cooked/Cleaned": ["smoked"],
    },
    "Condiments & Snacks": {
        "Processing": ["dehydrated", "powder", "in juice", "in syrup"],
        "Seed/Bone": ["pitted"],
        "Dietary Accommodation": ["non-dairy"],
    },
    "Beverages": {
        "Shape": ["thickened"],
        "Flavor/Cut": ["mix"],
        "Dietary Concern": ["decaffeinated", "diet", "caffeinated"],
        "Frozen": ["iced"],
    },
    "Milk & Dairy": {
        "Processing": ["evaporated", "powder", "grated"],
        "Dietary Concern": ["1%", "2%"],
        "Dietary Accommodation": ["lactose free"],
    },
    "Produce": {"Processing": ["in brine"]},
    "Fruit": {"Seed/Bone": ["pitted"], "Processing": ["in juice", "in gel", "in syrup"]},
    "Cheese": {"Shape": ["crumble"]},
    "Milk": {"Shape": ["thickened"]},
    "Yogurt": {"Shape": ["thickened"]},
    "Legumes": {"Processing": ["dehydrated"]},
    "Roots & Tubers": {"Processing": ["dehydrated"]},
    "Eggs": {"Processing": ["hard boiled"]},
    "Pork": {"Shape": ["iberico"]},
}
# Groups whose own copy of a column drops a tag and is not shared onwards.
PRIVATE_SCOPES = {"Meals": {"Processing": ["whipped"]}, "Meat": {"Processing": ["whipped"]}}

# ---------------------------------------------------------------------------------------------
# Basic types that expand to several columns.
TYPE_MAP = {
    "sea salt": {"Basic Type": "salt"},
    "fruit blend": {"Basic Type": "fruit", "Sub-Types": ["blend"]},
    "apple. Gala": {"Basic Type": "apple", "Sub-Types": ["gala"]},
    "apple. gala": {"Basic Type": "apple", "Sub-Types": ["gala"]},
    "apple golden delicious": {"Basic Type": "apple", "Sub-Types": ["golden delicious"]},
    "almond": {"Basic Type": "nut", "Sub-Types": ["almond"]},
    "baba ganoush": {"Basic Type": "spread", "Sub-Types": ["baba ganoush"]},
    "baklava": {"Basic Type": "pastry", "Sub-Types": ["baklava"]},
    "banana bread": {"Basic Type": "bread", "Sub-Types": ["banana"]},
    "barbacoa": {"Basic Type": "beef", "Sub-Types": ["barbacoa"]},
    "basil": {"Basic Type": "herb", "Sub-Types": ["basil"]},
    "bell pepper": {"Basic Type": "pepper", "Sub-Types": ["bell"]},
    "bran": {"Basic Type": "wheat bran"},
    "bratwurst": {"Basic Type": "pork", "Sub-Types": ["sausage"]},
    "breakfast bar": {"Basic Type": "bar"},
    "brownie": {"Basic Type": "dessert", "Sub-Types": ["brownie"]},
    "cake": {"Basic Type": "dessert", "Sub-Types": ["cake"]},
    "cannoli cream": {"Basic Type": "filling", "Sub-Types": ["cannoli"]},
    "cereal bar": {"Basic Type": "bar"},
    "cheesecake": {"Basic Type": "dessert", "Sub-Types": ["cheesecake"]},
    "chorizo": {"Basic Type": "pork", "Sub-Types": ["sausage"]},
    "clam juice": {"Basic Type": "juice", "Sub-Types": ["clam"]},
    "clover sprout": {"Basic Type": "sprout", "Sub-Types": ["clover"]},
    "club soda": {"Basic Type": "soda", "Sub-Types": ["club"]},
    "cooking wine": {"Basic Type": "wine", "Sub-Types": ["cooking"]},
    "cornish hen": {"Basic Type": "chicken", "Sub-Types": ["cornish hen"]},
    "crème fraiche": {"Basic Type": "cream", "Sub-Types": ["fraiche"]},
    "cupcake": {"Basic Type": "dessert", "Sub-Types": ["cupcake"]},
    "danish": {"Basic Type": "pastry", "Sub-Types": ["danish"]},
    "eggnog": {"Basic Type": "drink", "Sub-Types": ["eggnog"]},
    "farina": {"Basic Type": "cereal", "Sub-Types": ["farina"]},
    "frank": {"Basic Type": "beef", "Sub-Types": ["frank"]},
    "frisee": {"Basic Type": "lettuce", "Sub-Types": ["frisee"]},
    "fruit basket": {"Basic Type": "fruit", "Sub-Types": ["variety"]},
    "hog": {"Basic Type": "pork", "Sub-Types": ["hog"]},
    "honeydew": {"Basic Type": "melon", "Sub-Types": ["honeydew"]},
    "iced tea": {"Basic Type": "tea", "Sub-Types": ["iced"]},
    "jalepeno": {"Basic Type": "pepper", "Sub-Types": ["jalepeno"]},
    "juice slushie": {"Basic Type": "juice", "Sub-Types": ["slushie"]},
    "ketchup": {"Basic Type": "condiment", "Sub-Types": ["ketchup"]},
    "marmalade": {"Basic Type": "spread", "Sub-Types": ["marmalade"]},
    "marshmallow": {"Basic Type": "candy", "Sub-Types": ["marshmallow"]},
    "miso": {"Basic Type": "paste", "Sub-Types": ["miso"]},
    "mozzarella": {"Basic Type": "cheese", "Sub-Types": ["mozzarella"]},
    "nori": {"Basic Type": "seaweed", "Sub-Types": ["nori"]},
    "peppercorn": {"Basic Type": "spice", "Sub-Types": ["peppercorn"]},
    "pesto": {"Basic Type": "sauce", "Sub-Types": ["pesto"]},
    "pig feet": {"Basic Type": "pork", "Sub-Types": ["feet"]},
    "pita": {"Basic Type": "bread", "Sub-Types": ["pita"]},
    "potato yam": {"Basic Type": "potato", "Sub-Types": ["yam"]},
    "prosciutto": {"Basic Type": "pork", "Sub-Types": ["prosciutto"]},
    "pudding": {"Basic Type": "dessert", "Sub-Types": ["pudding"]},
    "romaine": {"Basic Type": "lettuce", "Sub-Types": ["romaine"]},
    "rotini": {"Basic Type": "pasta"},
    "sauerkraut": {"Basic Type": "condiment", "Sub-Types": ["sauerkraut"]},
    "seasoning tajin": {"Basic Type": "seasoning", "Sub-Types": ["tajin"]},
    "slush": {"Basic Type": "juice", "Sub-Types": ["slushie"]},
    "spam": {"Basic Type": "pork", "Sub-Types": ["spam"]},
    "spring mix": {"Basic Type": "lettuce", "Sub-Types": ["spring mix"]},
    "squash blossom": {"Basic Type": "squash", "Sub-Types": ["blossom"]},
    "sunflower": {"Basic Type": "seed", "Sub-Types": ["sunflower"]},
    "sweet potato": {"Basic Type": "potato", "Sub-Types": ["sweet"]},
    "tostada": {"Basic Type": "shell", "Sub-Types": ["tostada"]},
    "trail mix": {"Basic Type": "snack", "Sub-Types": ["trail mix"]},
    "turnip greens": {"Basic Type": "turnip", "Sub-Types": ["greens"]},
    "vegetable mix": {"Basic Type": "vegetable", "Sub-Types": ["blend"]},
    "vegetable blend": {"Basic Type": "vegetable", "Sub-Types": ["blend"]},
    "whipped cream": {"Basic Type": "topping", "Sub-Types": ["whipped cream"]},
    "cantaloupe": {"Basic Type": "melon", "Sub-Types": ["cantaloupe"]},
    "blend": {"Basic Type": "vegetable", "Sub-Types": ["blend"]},
    "soy sauce": {"Basic Type": "condiment", "Sub-Types": ["soy sauce"]},
    "chicken breast": {"Basic Type": "chicken", "Shape": "breast"},
    "chicken tender": {"Basic Type": "chicken", "Shape": "cut"},
    "chicken nugget": {"Basic Type": "chicken", "Shape": "nugget"},
    "chocolate": {"Basic Type": "candy", "Sub-Types": ["chocolate"]},
    "chutney": {"Basic Type": "spread", "Sub-Types": ["chutney"]},
    "coleslaw": {"Basic Type": "salad", "Sub-Types": ["coleslaw"]},
    "corn nugget": {"Basic Type": "appetizer", "Sub-Types": ["corn"], "Processing": "battered"},
    "gel": {"Basic Type": "topping", "Sub-Types": ["icing"]},
    "ice cream cone": {"Basic Type": "cone", "Sub-Types": ["ice cream"]},
    "pan coating": {"Basic Type": "oil", "Sub-Types": ["spray"]},
    "paprika": {"Basic Type": "spice", "Sub-Types": ["paprika"]},
    "salad mix": {"Basic Type": "lettuce", "Sub-Types": ["blend"]},
    "toast": {"Basic Type": "bread", "Sub-Types": ["toast"]},
    "turmeric": {"Basic Type": "spice", "Sub-Types": ["turmeric"]},
    "orange blossom water": {"Basic Type": "water", "Sub-Types": ["flavored"]},
    "gyro meat": {"Basic Type": "beef", "Sub-Types": ["lamb", "gyro"]},
    "yogurt alternative": {"Basic Type": "yogurt", "Dietary Accommodation": "non-dairy"},
    "cashew": {"Basic Type": "nut", "Sub-Types": ["cashew"]},
    "pecan": {"Basic Type": "nut", "Sub-Types": ["pecan"]},
    "pistachio": {"Basic Type": "nut", "Sub-Types": ["pistachio"]},
    "hazelnut": {"Basic Type": "nut", "Sub-Types": ["hazelnut"]},
    "walnut": {"Basic Type": "nut", "Sub-Types": ["walnut"]},
    "macadamia": {"Basic Type": "nut", "Sub-Types": ["macadamia"]},
    "kukui": {"Basic Type": "nut", "Sub-Types": ["kukui"]},
}

# Exact product types whose whole row is given.
PRODUCT_TYPE_OVERRIDES = {
    "TOMATO HEIRLOOM CHERRY MIX 12 PT": {"Basic Type": "tomato", "Sub-Types": ["cherry"]},
    "HAWAIIAN PUNCH CANS": {"Basic Type": "drink", "Sub-Types": ["fruit punch"]},
    "Concentrate Chipotle S/O": {"Basic Type": "chipotle", "Shape": "concentrate"},
    "OREGANO AQUARESIN (7.5LB/PL)": {
        "Basic Type": "spice",
        "Sub-Types": ["oregano"],
        "Shape": "concentrate",
    },
    "GRAIN, BLEND COUSCOUS TRI-COLOR QUINOA RESEALABLE BAG": {
        "Basic Type": "quinoa",
        "Sub-Types": ["couscous", "blend"],
    },
    "GREEN, MUST CHPD DMSTC IQF FZN": {
        "Basic Type": "mustard green",
        "Shape": "cut",
        "Frozen": "frozen",
    },
    "Turkey Cranberry Snack Sticks": {"Basic Type": "turkey", "Sub-Types": ["jerky"]},
    "TURKEY STICK SMOKEHOUSE": {"Basic Type": "turkey", "Sub-Types": ["jerky"]},
    "APPETIZER, CHICKEN COCONUT SKEWER .85 OZ COOKED FROZEN KABOB": {
        "Basic Type": "chicken",
        "Sub-Types": ["kabob", "coconut"],
        "Cooked/Cleaned": "cooked",
        "Frozen": "frozen",
    },
    "APPETIZER, CHICKEN SKEWER .8 OZ PARCOOKED FROZEN": {
        "Basic Type": "chicken",
        "Sub-Types": ["kabob"],
        "Cooked/Cleaned": "cooked",
    },
    "WG RAMEN MISO NOODLE KIT": {
        "Basic Type": "meal kit",
        "Sub-Types": ["noodle", "miso"],
        "WG/WGR": "whole grain rich",
    },
    "EDAMAME SUCCOTASH BLEND": {
        "Food Product Group": "Produce",
        "Food Product Category": "Vegetables",
        "Primary Food Product Category": "Vegetables",
        "Basic Type": "vegetable",
        "Sub-Types": ["blend", "edamame", "succotash"],
    },
    "MIX CAKE BASE RICHCREME": {"Basic Type": "dessert", "Sub-Types": ["cake", "mix"]},
    "QUICK OATS TUBES": {"Basic Type": "oat", "Sub-Types": ["quick"]},
    "RICE PILAF CHICKEN W/ORZO": {
        "Basic Type": "entree",
        "Sub-Types": ["chicken", "rice pilaf"],
    },
    "GRAIN SPCLTY BULGHUR WHEAT PLF": {
        "Basic Type": "bulgur",
        "Sub-Types": ["wheat", "pilaf"],
    },
    "POLENTA, CAKE VEG FIRE RSTD (6455314)": {
        "Basic Type": "entree",
        "Sub-Types": ["polenta", "vegetable"],
    },
    "ROOT TARO MALANGA COCA": {"Basic Type": "taro"},
    "SHORTBREAD STRAWBERRY": {"Basic Type": "dessert", "Sub-Types": ["shortbread", "strawberry"]},
    "SCOOBY DOO GRAHAM STIX IW": {
        "Basic Type": "cracker",
        "Sub-Types": ["graham"],
        "WG/WGR": "whole grain rich",
        "Packaging": "ss",
    },
    "BEAN, GOURMET MADAGASCAR BOURB (4648664)": {
        "Basic Type": "spice",
        "Sub-Types": ["vanilla bean"],
    },
    "PATE-PORK PISTACHIO OLYM 6/8 OZ": {"Basic Type": "pate", "Sub-Types": ["pork"]},
    "PATE-PORK RILLETE OLYM 6/8 OZ": {"Basic Type": "pate", "Sub-Types": ["pork"]},
    "ORANGE, BLOOD CNCNT FZN": {
        "Basic Type": "orange",
        "Shape": "concentrate",
        "Frozen": "frozen",
    },
    "GRAIN, WHEAT RED BRRY": {"Basic Type": "wheat berry"},
    "BENEFIT BRFST BAR OAT/RSN IW": {
        "Basic Type": "bar",
        "Sub-Types": ["oat"],
        "Packaging": "ss",
    },
    "SANDWICH CHILI CHS DOG IW": {
        "Basic Type": "sandwich",
        "Shape": "hot dog",
        "Sub-Types": ["beef", "pork"],
    },
    "BREAKFAST STICK CHORIZO BEEF CHEESE I/W": {
        "Basic Type": "entrée",
        "Sub-Types": ["beef", "cheese"],
    },
    "PHYLLO STAR FIG & GOAT CHEESE 60 CT SK": {
        "Basic Type": "appetizer",
        "Sub-Types": ["fig", "cheese"],
    },
    "DRINK TEA CHAI CLDB COF CSHWMK": {
        "Basic Type": "tea",
        "Sub-Types": ["chai"],
        "Dietary Accommodation": "non-dairy",
        "Shape": "concentrate",
        "Additives": "no additives",
    },
    "DRINK TEA CHAI CASHEWMILK": {
        "Basic Type": "tea",
        "Sub-Types": ["chai"],
        "Dietary Accommodation": "non-dairy",
        "Shape": "concentrate",
        "Additives": "no additives",
    },
}

# Sub-type tokens that stand for column values. The values become sub-types and the
# token itself is dropped.
SUBTYPE_VALUES = {
    "2% lactose free": ["lactose free", "2%"],
    "apple juice": ["juice"],
    "cheez-it": ["cracker"],
    "french toast bread": ["french toast"],
    "fruit bar": ["popsicle"],
    "gherkin": ["condiment"],
    "gravy master": ["sauce"],
    "whole grain rich ss": ["whole grain rich", "ss"],
    "ham diced": ["pork", "cut"],
    "hanger steak": ["beef", "cut"],
    "low fat ss": ["low fat", "ss"],
    "mucho queso": ["sauce"],
    "nutter butter": ["snack"],
    "vegan mayonnaise": ["vegan"],
    "dried banana": ["dried"],
    "jerk chicken": ["seasoned"],
    "chicken strips": ["cut"],
    "scrambled eggs": ["cooked"],
    "lemon pepper fish": ["seasoned"],
    "blueberry cream cheese": ["cheese", "flavored"],
    "veggie patty": ["patty"],
    "marrow bone pipe": ["marrow bone", "cut"],
    "green commodity": ["commodity"],
    "gluten free ss": ["gluten free", "ss"],
}

# One sub-type token that stands for several. FRONT_EXPANSIONS go first.
SUBTYPE_EXPANSIONS = {
    "fried onion": ["onion", "fried"],
    "long grain and wild": ["long grain", "wild"],
    "pea & carrot": ["pea", "carrot"],
    "pea and carrot": ["pea", "carrot"],
    "fruit and nut": ["fruit", "nut"],
    "ham and cheese": ["ham", "cheese"],
    "mozzarella provolone": ["mozzarella", "provolone"],
    "bean hummus": ["bean", "hummus"],
    "vegetarian chili": ["chili", "vegetable"],
    "spicy crab roll": ["crab", "roll"],
    "cheetos": ["corn", "cheese"],
    "barley. instant": ["barley", "instant"],
}
FRONT_EXPANSIONS = ["fried onion", "vegetarian chili"]

# Cereal brands and the grains they stand for.
CEREAL_GRAINS = {
    "cocoa puffs": ["corn", "cocoa"],
    "crispix": ["rice", "corn"],
    "cap'n crunch": ["corn", "oat"],
    "apple jacks": ["corn", "wheat", "oat", "apple jacks"],
    "tootie fruities": ["corn", "wheat", "oat", "tootie fruities"],
    "cinnamon toasters": ["wheat", "rice"],
    "special k": ["rice", "wheat", "oat"],
    "cocoa krispies": ["rice", "cocoa"],
    "life": ["oat", "wheat", "corn"],
}

# ---------------------------------------------------------------------------------------------
# Closed word lists named by the rules.
VOCABULARIES = {
    "fruits": [
        "orange", "guava", "apple", "berry", "lemon", "lime", "strawberry", "banana",
        "raspberry", "passion fruit", "pomegranate", "acai", "blueberry", "cherry", "peach",
        "pear", "watermelon", "watermelon strawberry", "coconut", "grapefruit", "mango",
        "blackberry", "black cherry", "pineapple", "tangerine",
    ],
    "vegetables": [
        "produce", "artichoke", "carrot", "cauliflower", "pea", "celery", "broccoli",
        "pepper", "onion", "green bean", "wax bean", "edamame", "eggplant", "zucchini",
        "corn", "jalapeno", "potato", "red pepper", "romaine", "snap pea", "spinach",
        "sundried tomato", "tomatillo", "tomato", "tomato basil",
    ],
    "nuts": [
        "almond", "cashew", "pecan", "pistachio", "hazelnut", "walnut", "macadamia", "kukui",
    ],
    "cheeses": [
        "iberico", "cheddar", "gruyere", "cheddar cheese", "monterey jack", "mozzarella",
        "jack", "provolone", "blue", "havarti", "gouda", "boursin", "brie", "muenster",
        "white cheddar", "feta", "gorgonzola", "pepper jack", "parmesan", "swiss",
        "sottocenere", "van sormon", "tomme de hood", "asiago", "fontina", "ciliegine",
        "baby caprino", "barricato al pepe", "piemontese", "cotjia", "halloumi", "chevre",
        "chihuahua", "port salut", "deep ellum blue", "cotija", "colby", "burrata",
        "colby jack", "ricotta", "wensleydale", "romano pecorino", "bucheron", "caciotta",
        "manchego", "cheddar jack", "american", "jarlsberg", "mascarpone", "menonina",
        "menonita", "asadero", "birdville reserve", "botalon", "taleggio",
    ],
    "melons": [
        "cantaloupe", "honeydew", "watermelon", "galia", "hami", "crenshaw", "malichita",
    ],
    "flavor_skipping_types": [
        "drink", "tea", "coffee", "candy", "condiment", "cereal", "oat", "bean", "ice cream",
        "cheesecake", "cracker", "dessert", "pastry", "cookie", "cake", "danish", "soda",
        "sports drink", "energy drink",
    ],
    "flavored_types": [
        "bread", "yogurt", "french toast", "chip", "cranberry", "spread", "butter",
        "fruit ice", "popsicle", "mix",
    ],
    "shape_skipping_types": ["chip", "candy"],
    "shape_extras": [
        "truffle", "bar", "bark", "tortilla", "triangle", "ridge", "round", "ridged",
        "lattice cut", "popped", "bowl", "scoop", "crisps", "fig newton", "fortune",
        "golden grahams", "teddy grahams",
    ],
    "chocolate_kinds": [
        "dark chocolate", "chocolate covered", "kit kat", "chocolate candy piece", "m&m",
        "twix", "chocolate coating", "chocolate cola", "chocolate dipped",
        "chocolate filled", "chocolate fudget", "chocolate m&m", "chocolate mint",
        "chocolate sauce", "chocolate semisweet", "chocolate vanilla swirl",
        "chocolate chunk",
    ],
    "cocoa_kinds": ["cocoa chip"],
    "corn_cereals": [
        "frosted corn flakes", "frosted flake", "frosted flakes", "honey nut chex", "trix",
        "froot loops", "chex", "kix", "corn chex", "corn pops", "corn pop", "corn puff",
        "corn flakes", "purple flake", "purple flakes",
    ],
    "wheat_cereals": [
        "frosted mini spooner", "frosted mini spooners", "frosted mini wheat",
        "frosted mini wheats", "frosted spooners", "frosted wheat", "frosted wheats",
        "fruit whirls", "kashi", "mini spooners", "spooners", "mini spooner",
        "wheat bran flakes", "wheat frosted", "wheaties", "shredded wheat", "total",
        "bran flakes", "bran flake", "raisin bran",
    ],
    "oat_cereals": [
        "fruity cheerios", "cheerios", "honey nut cheerios", "honey scooters",
        "lucky charms", "multigrain o", "multigrain oats", "toasted oats",
        "toasted white chocolate", "toasty o",
    ],
    "fruit_snacks": [
        "fruit roll up", "fruit roll-up", "fruit rolls", "fruit rollup", "fruit snack",
        "gusher",
    ],
}

# What several sub-types of one kind collapse to. Vegetables never collapse.
COLLAPSE = {"fruits": "fruit", "cheeses": "blend", "melons": "variety"}
# Kinds are tried in this order; the first list that holds the word decides.
COLLAPSE_ORDER = ["fruits", "cheeses", "vegetables", "melons"]

# ---------------------------------------------------------------------------------------------
# Starter selections of the open-ended vocabularies (full lists: a parameter).
CORRECTIONS = {
    # spelling
    "talapia": "tilapia",
    "omlete": "omelette",
    "grapefuit": "grapefruit",
    "cheedar": "cheddar",
    "gerkin": "gherkin",
    "rapsberry": "raspberry",
    "rasberry": "raspberry",
    "tamato": "tomato",
    "mozzerella": "mozzarella",
    "tumeric": "turmeric",
    "siced": "sliced",
    "gryo meat": "gyro meat",
    "jalepeno": "jalapeno",
    "canteloupe": "cantaloupe",
    "montery jack": "monterey jack",
    # one word for several spellings
    "carrots": "carrot",
    "cranberries": "cranberry",
    "egg": "eggs",
    "onions": "onion",
    "oats": "oat",
    "peppers": "pepper",
    "vegetables": "vegetable",
    "grapes": "grape",
    "chick pea": "chickpea",
    "gluten-free": "gluten free",
    "sugar-free": "sugar free",
    "fat-free": "fat free",
    "low-fat": "low fat",
    "lowfat": "low fat",
    "non fat": "nonfat",
    "skim": "nonfat",
    "non dairy": "non-dairy",
    "skin-on": "skin on",
    "bone in": "bone-in",
    "cheez it": "cheez-it",
    "froot loop": "froot loops",
    "apple jack": "apple jacks",
    "cheeto": "cheetos",
    "captain crunch": "cap'n crunch",
    "corn flake": "corn flakes",
    "cheerio": "cheerios",
    "cocoa": "cocoa powder",
    "entree": "entrée",
    "beverage": "drink",
    "meatballs": "meatball",
    "wings": "wing",
    "ribs": "rib",
    "hanger": "hanger steak",
    "flank steak": "steak",
    "top round": "round",
    "feta cheese": "feta",
    "crumbled": "crumble",
    "bbq": "barbecue",
    "barbeque": "barbecue",
    "assorted": "variety",
    "basil": "herb",
    "spice": "seasoned",
    "season": "seasoned",
    "salt and pepper": "seasoned",
    "quick": "instant",
    "decaf": "decaffeinated",
    "zero sugar": "diet",
    "bouillon": "base",
    "Cuban": "cuban",
    "cubano": "cuban",
    # preparation
    "roast": "cooked",
    "roasted": "cooked",
    "baked": "cooked",
    "fried": "cooked",
    "grill": "cooked",
    "steamed": "cooked",
    "scrambled": "cooked",
    "hard-boiled": "hard boiled",
    "hardboiled": "hard boiled",
    "smoke": "smoked",
    "hickory smoked": "smoked",
    "crusted": "breaded",
    "powdered": "powder",
    "condensed": "concentrate",
    # shape
    "sliced": "cut",
    "diced": "cut",
    "chopped": "cut",
    "wedge": "cut",
    "strip": "cut",
    "fillet": "filet",
    "filet": "cut",
    "chunk": "cut",
    "chunks": "cut",
    # grain, package, liquid
    "whole wheat": "whole grain rich",
    "whole grain": "whole grain rich",
    "bag": "ss",
    "packet": "ss",
    "pouch": "ss",
    "jar": "jarred",
    "can": "canned",
    "in olive oil": "in oil",
    "in heavy syrup": "in syrup",
    "light syrup": "in light syrup",
    "in light syrup": "in syrup",
    "brine": "in brine",
}
SKIPPED = [
    "organic", "breakfast", "holiday", "cold brew", "fresh", "washed", "coke", "kind",
    "sriracha", "honey wheat", "salted caramel", "boneless", "homestyle", "instant", "loaf",
    "round", "old fashioned", "seeded", "red", "yellow", "green", "gold", "white", "blue",
    "black", "brown", "orange", "purple", "mini", "snack", "cob", "chorizo", "uncured",
    "spicy", "glazed", "plain", "virgin", "extra virgin", "chewy", "elbow", "fettuccine",
    "macaroni", "penne", "spaghetti", "ziti", "long grain", "jumbo", "large", "medium", "ring",
    "soft", "hard", "liquid", "Persian", "sea salt", "cleaned", "raw", "shelled", "skinless",
    "granulated", "light", "low sugar", "flake", "shaved", "whole", "no sugar", "sugar free",
    "link", "ball", "chunky", "clear", "coated", "feet", "fine", "frosted", "french toast shape",
    "guajillo chile", "head", "mild", "original", "quick", "reduced fat", "sharp", "sourdough",
    "sweetened", "table", "thin", "toasted", "top", "triangle", "turtle", "wide", "pinto",
    "kidney", "navy",
]
FLAVORS = [
    "mocha", "vanilla", "cinnamon", "maple", "butterscotch", "coffee", "caramel", "m&m", "milk",
    "garlic", "chili", "barbecue", "sea salt", "cheddar", "sour", "white cheddar", "sour cream",
    "variety", "queso", "salt", "vinegar", "brown sugar", "apple cinnamon", "seasoned",
    "horseradish", "chives", "sauce", "beer", "chipotle", "mint", "chocolate", "orange blossom",
    "peach tea", "mixed berry", "mixed fruit", "wildberry", "wild cherry", "strawberry kiwi",
    "strawberry lemonade", "strawberry shortcake", "sour apple", "honey barbecue",
    "sour cream and onion", "salt and vinegar", "chocolate covered", "cookies and cream",
    "dark chocolate", "fruit punch", "french vanilla", "teriyaki", "tropical", "red velvet",
    "vanilla almond", "green apple", "cool ranch",
]
