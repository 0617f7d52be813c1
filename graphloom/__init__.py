"""graphloom: a Spark-native engine for questions over property graphs.

Graph matching, evidence filtering, ranking and path search are DataFrame
plans; the training-data operators of the core live in ``operators`` and those
for language-model text in the separate subpackage ``llm``.
"""
