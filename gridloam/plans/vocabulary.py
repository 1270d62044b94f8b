"""Words and tables that questions are read with. Fixed values, in the order of their source.

Words that hold another word of their list are left out, as the shorter one is found wherever they are.
"""

from __future__ import annotations

NATIONAL = "india"
REGIONS = [
    "rajasthan", "maharashtra", "karnataka", "tamil nadu", "andhra pradesh", "telangana", "uttar pradesh", "bihar", "madhya pradesh", "gujarat",
    "west bengal", "punjab", "himachal pradesh", "uttarakhand", "goa", "kerala", "haryana", "assam", "odisha", "jharkhand",
    "chhattisgarh", "arunachal pradesh", "manipur", "meghalaya", "mizoram", "nagaland", "sikkim", "tripura", "jammu and kashmir", "ladakh",
]
#: Region to west, south, east and north.
BOXES = {
    "india": (68.0, 6.0, 98.0, 37.5), "andhra pradesh": (76.8, 12.6, 84.8, 19.9), "arunachal pradesh": (91.5, 26.5, 97.4, 29.5), "assam": (89.7, 24.1, 96.0, 27.9),
    "bihar": (83.3, 24.3, 88.3, 27.5), "chhattisgarh": (80.3, 17.8, 84.4, 24.1), "goa": (73.9, 14.9, 74.4, 15.8), "gujarat": (68.2, 20.1, 74.5, 24.7),
    "haryana": (74.5, 27.7, 77.6, 30.9), "himachal pradesh": (75.6, 30.4, 79.0, 33.2), "jharkhand": (83.3, 21.9, 87.9, 25.3), "karnataka": (74.0, 11.5, 78.6, 18.5),
    "kerala": (74.9, 8.2, 77.4, 12.8), "madhya pradesh": (74.0, 21.1, 82.8, 26.9), "maharashtra": (72.6, 15.6, 80.9, 22.0), "manipur": (93.0, 23.8, 94.8, 25.7),
    "meghalaya": (89.8, 25.0, 92.8, 26.1), "mizoram": (92.3, 21.9, 93.5, 24.5), "nagaland": (93.3, 25.2, 95.2, 27.0), "odisha": (81.4, 17.8, 87.5, 22.6),
    "punjab": (73.9, 29.5, 76.9, 32.5), "rajasthan": (69.5, 23.0, 78.3, 30.2), "sikkim": (88.0, 27.1, 88.9, 28.1), "tamil nadu": (76.2, 8.0, 80.4, 13.6),
    "telangana": (77.2, 15.8, 81.4, 19.9), "tripura": (91.1, 22.9, 92.3, 24.5), "uttar pradesh": (77.1, 23.9, 84.6, 30.4), "uttarakhand": (77.6, 28.7, 81.1, 31.5),
    "west bengal": (85.8, 21.5, 89.9, 27.2), "jammu and kashmir": (73.9, 32.3, 80.4, 37.1), "ladakh": (75.9, 32.0, 79.5, 35.5), "delhi": (76.8, 28.4, 77.4, 28.9),
    "chandigarh": (76.7, 30.6, 76.9, 30.8),
}
#: Other spellings and short names.
ALIASES = {"ap": "andhra pradesh", "up": "uttar pradesh", "mp": "madhya pradesh", "jk": "jammu and kashmir", "tn": "tamil nadu", "hp": "himachal pradesh", "chhatisgarh": "chhattisgarh", "jammu & kashmir": "jammu and kashmir"}
BANDS = ("soil_moisture_am", "soil_moisture_pm")

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Season to its months, in order; a season that passes December ends in the next year.
SEASONS = {
    "pre-monsoon": (3, 4, 5), "premonsoon": (3, 4, 5), "post-monsoon": (10, 11), "postmonsoon": (10, 11), "rabi": (10, 11, 12, 1, 2, 3), "kharif": (6, 7, 8, 9, 10, 11),
    "summer": (3, 4, 5), "winter": (12, 1, 2), "spring": (3, 4, 5), "monsoon": (6, 7, 8, 9), "rainy": (6, 7, 8, 9), "autumn": (9, 10, 11), "fall": (9, 10, 11),
    "jjas": (6, 7, 8, 9), "mam": (3, 4, 5), "on": (10, 11), "djf": (12, 1, 2), "djfm": (12, 1, 2, 3), "jf": (1, 2), "jja": (6, 7, 8), "son": (9, 10, 11), "amj": (4, 5, 6),
}
#: Where the evaluation's calendar differs.
EVALUATION_SEASONS = {"kharif": (6, 7, 8, 9), "post-monsoon": (10, 11, 12), "postmonsoon": (10, 11, 12)}

GREETINGS = ("hi", "hello", "hey", "thanks", "thank you", "bye", "goodbye", "how are you", "who are you", "what can you do", "help")
LITERATURE = (
    "algorithm", "retrieval", "methodology", "lprm", "tau-omega", "backscatter", "dielectric", "emissivity", "amsr", "smos", "smap", "sentinel", "passive microwave", "active microwave",
    "optical depth", "rmse", "bias", "validation", "calibration", "ieee", "proceedings", "doi", "published", "journal", "article", ".pdf", "according to", "figure", "fig.", "fig ", "table ",
    "tab.", "tab ", "in the paper", "in the study", "in the literature", "the paper says", "the study says", "literature says", "literature on",
)
DATA = ("mean", "average", "minimum", "maximum", "trend", "slope", "compare", "comparison")
COVERAGE = (
    "how many years", "years of data", "temporal coverage", "data coverage", "dataset span", "available data", "time range", "full dataset", "all years", "how long", "date range",
    "since when", "start date", "end date", "data available", "dataset range", "coverage period", "historical data", "archive coverage",
)
BEST_YEAR = (
    "which year", "what year", "best year", "worst year", "highest national", "lowest national", "wettest year nationally", "driest year nationally", "highest average soil moisture",
    "lowest average soil moisture", "most moisture nationally", "least moisture nationally",
)
COMPARING = ("compar", "versus", " vs ", " vs.", "differ", "contrast")
PAPER = ("according to", ".pdf", "in the paper", "in the study", "from the paper", "in the literature", "published", "findings")
MEAN = ("mean", "average", "avg", "typical", "normal")
SLOPE = ("trend", "slope", "increasing", "decreasing", "drying", "wetting", "over time", "getting", "change over", "temporal", "time series", "trajectory")
SLOPE_UNLESS_PAPER = ("rate", "change")
SCALAR_ONLY = (
    "only the value", "only value", "only number", "just the value", "just value", "just number", "only scalar", "no map", "without map", "scalar only", "number only", "value only",
    "text only", "no visualization", "no visualisation", "just the number", "single value", "only the result",
)
BOTH = (
    "both map and value", "both value and map", "map and value", "value and map", "map and number", "number and map", "map and statistic", "statistic and map", "include map", "with map",
    "show with map", "map along with", "along with map",
)
MAP_WORDS = ("map", "spatial", "visuali", "geographic", "show", "display", "generate map", "produce map", "plot", "draw", "render", "image", "distribution")
SCALAR_WORDS = ("what is", "what was", "what are", "tell me", "give me the", "report", "numerical", "statistic")
SENSOR = ("smap", "gee", "google earth engine", "soil_moisture_am", "soil_moisture_pm")
OFF_TOPIC = (
    "celebrity", "movie", "music", "song", "playlist", "actor", "actress", "sports score", "nba", "nfl", "football score", "cricket score", "bollywood", "hollywood", "instagram", "tiktok",
    "youtube video", "write code", "debug my code", "html code", "css style", "javascript", "fix my bug", "syntax error", "python script for", "mars soil", "lunar soil", "moon soil",
    "martian", "venus", "jupiter", "saturn", "asteroid", "nasa mars", "recipe", "how to cook", "baking", "restaurant", "stock price", "cryptocurrency", "bitcoin", "election result",
    "president of", "tell me a joke", "write a poem", "write a story",
)
#: A question with one of these is on topic whatever else it holds.
ON_TOPIC = (
    "soil", "moisture", "satellite", "remote sensing", "amsr", "smap", "smos", "monsoon", "rainfall", "crop", "agriculture", "india", "climate", "microwave", "ndvi", "evapotranspiration",
    "drought", "irrigation", "hydrology", "water", "precipitation", "runoff", "groundwater", "vegetation", "land surface", "temperature", "humidity", "meteorology", "rabi", "kharif",
    "rajasthan", "punjab", "gujarat", "kerala", "telangana", "hyderabad", "delhi", "mumbai", "forest", "canopy", "soil carbon", "permafrost", "glacier", "snow", "surface water", "catchment",
    "watershed", "flood", "cyclone", "heat wave", "el nino", "la nina", "imd", "noaa", "nasa", "esa", "isro", "copernicus", "weather", "rain", "wind", "storm", "fog", "mist", "frost", "heat",
    "cold wave", "heatwave", "dew", "vapour", "vapor", "wheat", "rice", "paddy", "soybean", "maize", "corn", "sugarcane", "cotton", "pulses", "lentil", "chickpea", "barley", "millet",
    "sorghum", "mustard", "groundnut", "sunflower", "jute", "tobacco", "tea", "coffee", "horticulture", "orchard", "reservoir", "river", "lake", "basin", "aquifer", "recharge",
    "infiltration", "porosity", "permeability", "clay", "silt", "sand", "loam", "peat", "organic matter", "humus", "saline", "bulk density", "field capacity", "wilting point",
    "rooting depth", "eos", "terra", "aqua", "sentinel", "landsat", "modis", "ndmi", "lswi", "lai", "fpar", "albedo", "emissivity", "lprm", "sar", "insar", "lidar", "goes", "viirs", "aster",
    "evaporation", "transpiration", "evapo", "latent heat", "surface energy", "carbon cycle", "nitrogen", "phosphorus", "biomass", "phenology", "ecosystem", "biome", "land use",
    "land cover", "deforestation", "reforestation", "afforestation", "desertification", "paper", "study", "research", "analysis", "algorithm", "validation", "rmse", "bias", "correlation",
    "retrieval", "method", "figure", "table", "chart", "graph", "plot", "result", "dataset", "observation", "sensor",
)

#: Words by which the two parts of a question are told apart.
SPLIT_LITERATURE = (".pdf", "according to", "in the paper", "in the study", "figure ", "table ", "ieee", "algorithm", "lprm", "methodology", "retrieval", "backscatter", "amsr", "smap")
SPLIT_DATA = ("maximum", "minimum", "mean", "average", "trend", "wettest", "driest", "highest", "lowest", "scalar")
#: The metric that an operation on one period gives when periods are compared.
AS_METRIC = {"mean": "mean", "minimum": "min", "maximum": "max"}
