"""Schemas of the data model. A missing value counts as the type's zero value; sources apply that directly after the scan."""

from __future__ import annotations

QUERY_LOG = "corpus string, corpusSize long, subcorpusSize long, timeProc double, query string, isSynthetic boolean, flaggedAsSlow boolean"
CORPORA = "corpus string, size long, lang string, altCorpus string"
REGEXP = "struct<startsWithWildCard:int,numConcreteChars:double,avgCharProb:double,wildcardScore:double,hasRange:int,charClasses:double>"
POSITION = f"struct<index:int,regexp:{REGEXP},hasSmallCardAttr:int,numAlternatives:int,posRepetition:double,hasNegation:int>"
#: What the parser's function returns for a query.
PARSED = f"struct<error:string,positions:array<{POSITION}>,numGlobConditions:int,containsMeet:int,containsUnion:int,containsWithin:int,adhocSubcorpus:double,containsContaining:int,alignedPart:int>"
EVALUATION = f"procTime double, q string, positions array<{POSITION}>, numGlobConditions int, containsMeet int, containsUnion int, containsWithin int, adhocSubcorpus double, containsContaining int, corpusSize double, namedSubcorpusSize double, alignedPart int"
PROPERTIES = "array<struct<structure:string,name:string,value:string>>"
NODES = "array<struct<id:int,parent_id:int,depth:int,rule:string,text:string>>"
VOTE_REPORT = "time timestamp, votes_for int, votes_against int, avg_certainty double, corpus string, num_errors int"
METADATA = "objective string, metric array<string>, scale_pos_weight double, max_depth int, learning_rate double, num_leaves int, min_child_samples int, subsample double, colsample_bytree double, random_state int, verbose int"
N_FEATURES = 50
