"""The standard topics over a web directory's category paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Topic name, included prefixes, excluded prefixes.
TOPIC_RULES: list[tuple[str, list[str], list[str]]] = [
    ("sport", ["Sports"], ["Sports/Cycling"]),
    ("health", ["Health"],
     ["Health/Medicine", "Business/Healthcare", "Health/Conditions_and_Diseases"]),
    ("bikes", ["Sports/Cycling", "Shopping/Sports/Cycling"], []),
    ("cars", ["Business/Automotive", "Shopping/Vehicles/Autos", "Recreation/Autos"], []),
    ("education", ["Reference/Education"], []),
    ("entertainment", ["Games", "Arts/Television", "Arts/Movies"], []),
    ("fashion",
     ["Shopping/Clothing", "Arts/Design/Fashion", "Business/Arts_and_Entertainment/Fashion",
      "Kids_and_Teens/Teen_Life/Fashion", "Business/Consumer_Goods_and_Services/Beauty",
      "Business/Consumer_Goods_and_Services/Clothing"], []),
    ("finance", ["Home/Personal_Finance", "Business/Financial_Services"], []),
    ("food", ["Recreation/Food", "Shopping/Food"], []),
    ("gardening",
     ["Home/Gardening", "Shopping/Tools/Gardening", "Shopping/Home_and_Garden/Patio/Furniture",
      "Shopping/Home_and_Garden/Plants", "Shopping/Home_and_Garden/Plants/Vegetables",
      "Shopping/Home_and_Garden/Garden_Accessories",
      "Home/Consumer_Information/Lawn_and_Garden"], []),
    ("home",
     ["Home", "Shopping/Home_and_Garden",
      "Business/Consumer_Goods_and_Services/Home_and_Garden"],
     ["Home/Gardening", "Home/Personal_Finance", "Home/Family/Multiple_Births/Celebrities",
      "Home/Consumer_Information/Lawn_and_Garden", "Home/Family"]),
    ("medical", ["Health/Medicine", "Business/Healthcare", "Health/Conditions_and_Diseases"], []),
    ("music", ["Arts/Music", "Business/Arts_and_Entertainment/Music"], []),
    ("news", ["News"], ["News/Weather"]),
    ("parents",
     ["Society/Issues/Education", "Kids_and_Teens", "Home/Family",
      "Social_Sciences/Psychology/Child_Psychology"],
     ["Home/Family/Multiple_Births/Celebrities"]),
    ("photography",
     ["Arts/Photography", "Shopping/Visual_Arts/Photography", "Shopping/Photography",
      "Business/Arts_and_Entertainment/Photography", "Kids_and_Teens/Arts/Photography"], []),
    ("property",
     ["Business/Real_Estate", "Business/Construction_and_Maintenance",
      "Science/Social_Sciences/Urban_and_Regional_Planning"], []),
    ("science", ["Science"], ["Science/Technology"]),
    ("technology", ["Science/Technology", "Computers", "Shopping/Consumer_Electronics"], []),
    ("travel",
     ["Recreation/Travel", "Home/Consumer_Information/Travel", "Shopping/Travel",
      "Regional/Europe/United_Kingdom/Travel_and_Tourism",
      "Regional/Europe/Travel_and_Tourism"], []),
]


def standard_rules(spark: SparkSession) -> DataFrame:
    """``TOPIC_RULES`` in the form ``load_rules`` gives."""
    return spark.createDataFrame(
        TOPIC_RULES, "name string, includes array<string>, excludes array<string>"
    )
