r"""Cue patterns of citing sentences, for Java's and Python's regular expressions alike (case is folded where
``(?i)`` is added by the reader). ``\b`` stands for a border of ASCII words."""

# Cues of the pair rules.
BUILD = [
    r"\bbuil(d|ds|t|ding)\s+(up)?on\b",
    r"\b(we|our\s+\w+|this\s+\w+)\s+(further\s+)?(extend|extends|generali[sz]e|generali[sz]es|adapt|adapts|modify|modifies)\b",
    r"\b(extension|generali[sz]ation|variant|modification)\s+of\b",
    r"\b(we|our\s+\w+)\s+follows?\b",
    r"\b(our|this|the\s+proposed)\s+(\w+\s+){0,3}(is|are)\s+(largely\s+|mainly\s+)?based\s+on\b",
    r"\binspired\s+by\b",
    r"\b(we|our\s+\w+)\s+(adopt|adopts|borrow|borrows|reuse|reuses)\b",
    r"\b(we|our\s+\w+)\s+(use|uses|employ|employs)\s+(the\s+|a\s+)?([\w-]+\s+){0,3}(architecture|model|layer|layers|module|backbone|encoder|decoder|mechanism|block|blocks|operator)\b",
]
# Fixed value: the one build cue that minds case.
BUILD_CITED = [r"\bfollow(ing)?\s+(the\s+)?(\[|\(|[A-Z][\w-]+\s+et\s+al|[A-Z][\w-]+\s*[\[(])"]
CONTRAST = [
    r"\bunlike\b",
    r"\bin\s+contrast\s+(to|with)\b",
    r"\bdiffer(s|ent)?\s+from\b",
    r"\bas\s+opposed\s+to\b",
]
COMPARE = [
    r"\boutperform(s|ed|ing)?\b",
    r"\bsurpass(es|ed|ing)?\b",
    r"\bsuperior\s+to\b",
    r"\bbetter\s+than\b",
    r"\bcompar(e|ed|es|ing|ison)\s+(\w+\s+){0,4}(to|with|against)\b",
    r"\bbaselines?\b",
    r"\bstate[\s-]of[\s-]the[\s-]art\b",
    r"\bcompetitive\s+(with|to)\b",
    r"\bimprove(s|d|ment|ments)?\s+(\w+\s+){0,2}over\b",
]
RESOURCE_NOUN = [r"\b(dataset|datasets|data\s+set|benchmark|benchmarks|corpus|corpora|code|codebase|implementation|library|toolkit|optimi[sz]er|initiali[sz]ation|pre-?trained|checkpoints?|splits?)\b"]
RESOURCE_VERB = [r"\b(use|uses|used|using|utili[sz]e[sd]?|adopt(ed)?|employ(ed)?|train(ed)?\s+on|evaluat(e|ed|ing)\s+on|available|provided|released|from)\b"]
RESOURCE_CLAUSE = [
    r"\b(use|uses|used|using|adopt|adopts|adopted|employ|employs|employed|utili[sz]e[sd]?|train(ed)?\s+on|evaluat\w*\s+(on|with)|pre-?trained\s+on|initiali[sz]ed\s+(with|from|by)|transfer\w*\s+\w+\s+to|regulari[sz]e\w*\s+\w+\s+with)(?![0-9A-Za-z_])[^.;:]{0,70}\b(datasets?|benchmarks?|corpus|corpora|code|codebase|implementation|library|toolkit|optimi[sz]er|framework|weights|splits?|initiali[sz]ation|smoothing|augmentation|regulari[sz]ation)\b",
    r"\b(datasets?|benchmarks?|corpus|corpora|code|codebase|implementation|optimi[sz]er|framework|weights|splits?)(?![0-9A-Za-z_])[^.;:]{0,40}\b(is|are|was|were)\s+(used|adopted|employed)\b",
]
FIRST_PERSON = [r"\b(we|our|ours|this\s+(paper|work))\b"]
TABLE_ROW = [r"([0-9]+\.[0-9]+[^0-9]+){4}"]

# Cues of the sentence rules.
FIRST_PERSON_BUILD = [
    r"(?<![\w-])(we|our|ours|us)(?![\w-])",
    r"^(in\s+)?this\s+(paper|work)\b",
    r"\b(this|the\s+proposed)\s+(model|method|approach|architecture|design|framework)\b",
]
ADAPT = [
    r"\b(is|are|was|were)\s+(largely\s+|mainly\s+|directly\s+|partly\s+)?(adapted|derived|built|extended|developed|modified)\s+(from|upon|on)\b",
    r"\badapt(s|ed|ing)?\s+from\b",
    r"\b(spatiotemporal\s+|temporal\s+)?adaptation\s+of\b",
    r"\bbased\s+on\b",
    r"\bextend(s|ed|ing)?\b",
    r"\b(particular|special)\s+(instances?|cases?)\s+of\s+(our|the\s+proposed)\b",
    r"\b(we|our\s+\w+)\s+(subsume|subsumes|generali[sz]e|generali[sz]es)\b",
    r"\b(we|our\s+\w+)\s+(use|uses|employ|employs|adopt|adopts)\s+(the\s+|a\s+)?([\w\"“”'‘’-]+\s+){0,3}(variant|version)\s+of\b",
    r"\bmotivated\s+by\s+(the\s+)?[^.;,]{0,40}\b(success|design|idea)\b",
]
PROTOCOL = [
    r"\bfollow(s|ed|ing)?(?![0-9A-Za-z_])[^.;]{0,80}\b(train(ing)?|schedul\w*|settings?|setup|protocols?|iterations?|epochs?|batch(\s+size)?|views?|crops?|evaluat\w*|learning\s+rate|lr|optimi[sz]\w*|augmentations?|hyper-?parameters?|recipes?|implementation\s+details?|inference|pre-?process\w*|splits?|metrics?|resolution|report\w*|results?|accuracy)\b",
    r"\b(train(ing|ed)?|evaluat\w*|inference|schedul\w*|settings?|protocols?|test(ing|ed)?)(?![0-9A-Za-z_])[^.;]{0,60}\bfollow(s|ed|ing)?\b",
    r"\b(same|identical|similar)\s+(training\s+|experimental\s+|evaluation\s+)?(settings?|setup|protocols?|configurations?|recipes?|hyper-?parameters?)\s+(as|to|with|of)\b",
    r"\bmatching\s+the\s+[\w-]+\s+used\s+(by|in)\b",
    r"\bresults?\s+(are|is|were)\s+(copied|taken|borrowed|reported)\s+from\b",
    r"\bhyper-?parameters?(?![0-9A-Za-z_])[^.;]{0,40}\b(directly\s+)?from\b",
    r"\b(sampl\w*|subsampl\w*)(?![0-9A-Za-z_])[^.;]{0,80}\bfollow(s|ed|ing)?\b",
    r"\b(same|identical)\s+([\w-]+\s+){0,2}(architectures?|models?|networks?|backbones?|configurations?)\s+(as|to)\b",
    r"\b(adopt\w*|use[sd]?|using|apply|applies|applied|employ\w*)(?![0-9A-Za-z_])[^.;]{0,40}\b(warm-?up|learning\s+rates?|lr\s+schedul\w*|epochs?|batch\s+sizes?|weight\s+decay|dropout|label[\s-]smoothing|data\s+augmentations?)\b",
    r"\bfollow(s|ed|ing)?(?![0-9A-Za-z_])[^.;]{0,120}\b(analys[ie]s|annotat\w*|label(l)?ing|measur\w*|runtime|latency|throughput)\b",
    r"\b(analys[ie]s|annotat\w*|label(l)?ing|measur\w*|runtime|latency|throughput)(?![0-9A-Za-z_])[^.;]{0,120}\bfollow(s|ed|ing)?\b",
    r"\bbased\s+on(?![0-9A-Za-z_])[^.;]{0,100},\s*we\s+(\w+\s+)?(analy[sz]e|study|investigate|evaluate|compare|measure|examine|benchmark)\b",
    r"\bwe\s+use(?![0-9A-Za-z_])[^.;]{0,100}\bsimilar\s+to\b",
    r"\b(adopt\w*|use[sd]?|using|reus\w*|borrow\w*)(?![0-9A-Za-z_])[^.;]{0,60}\b(set-?ups?|code\s*-?bases?|experimental\s+settings?)\b",
]
FAIR = [r"\b(for|to\s+make)\s+(a\s+)?fair(er)?\s+comparisons?\b", r"\bfair(ly)?\s+compar\w*"]
ABLATION = [r"\b(we|also)\s+(also\s+)?(try|tried|experiment(ed)?\s+with|test(ed)?|replace[ds]?)\b", r"\bablat\w*"]
STRONG_BUILD = [
    r"\bbuil(?:d|ds|t|ding)\s+(?:up)?on\b",
    r"\bbuil(?:d|ds|t|ding)\s+on\s+top\s+of\b",
    r"\bextend(?:s|ed|ing)?\b",
    r"\bextension\s+of\b",
    r"\bgenerali[sz](?:e|es|ed|ing)\b",
    r"\bgenerali[sz]ation\s+of\b",
    r"\bsubsume[sd]?\b",
    r"\bimprov(?:e|es|ed|ing)\s+(?:up)?on\b",
    r"\b(?:variant|version|adaptation|modification|instantiation|application)\s+of\b(?!\s+\w+ing\b)",
    r"\b(?:adapted|derived)\s+from\b",
    r"\badapt(?:s|ing)?\s+from\b",
    r"\b(?:particular|special)\s+(?:instances?|cases?)\s+of\s+(?:our|the\s+proposed)\b",
]
WEAK_BUILD = [
    r"\b(?:we|our\s+\w+)\s+(?:also\s+)?(?:adopt|adopts|borrow|borrows|reuse|reuses|use|uses|employ|employs|leverage|leverages|utili[sz]e|utili[sz]es|modify|modifies|adapt|adapts)\b",
    r"\bfollow(?:s|ed|ing)?\b",
    r"\bbased\s+on\b",
    r"\binspired\s+by\b",
    r"\bmotivated\s+by\b",
]
INSTANCE_OF_OURS = [r"\b(particular|special)\s+(instances?|cases?)\s+of\s+(our|the\s+proposed)\b"]
WHILE_OURS = [r"^\s*(while|whereas)(?![0-9A-Za-z_])[^,;]{0,200},\s*(we|our)\b"]
OWN_APPLICATION = [r"^\s*(?:while|whereas)(?![0-9A-Za-z_])[^,;]{0,200},\s*our\s+(?:[\w-]+\s+){0,2}(?:application|use|usage|version|variant|instantiation|extension|generali[sz]ation|adaptation)\s+of\b"]
REPLACED = [r"\binstead\s+of\b", r"\brather\s+than\b", r"\breplac(e|es|ed|ing)\b"]
# What makes a strong cue a mere use of a thing.
USAGE_NOUNS = r"benchmarks? datasets? databases? corpus corpora suites? testbeds? environments? simulators? gyms? tasks? metrics? accuracy scores? scoring evaluations? protocols? set-?ups? settings? configurations? configs? hyper-?parameters? experiments? annotations? labels? toolkits? librar(?:y|ies) code-?bases? code implementations? packages? repositor(?:y|ies) apis? prompts? prompting templates? formats? judges? rubrics? splits? checkpoints? weights tokeni[sz]ers? probing probes? analys[ie]s practices? recipes? notations? terminology".split()
RESOURCE_TITLE = r"\b(?:[Bb]enchmarks?|[Bb]enchmarking|[Dd]atasets?|[Dd]atabases?|[Cc]orpus|[Ss]uite|[Tt]oolkit|[Tt]oolbox|[Ll]ibrary|[Gg]ym|[Aa]rena|[Ll]eaderboard|[Tt]estbed|[Ss]imulator)\b|\b[A-Z][\w-]*Bench\b|\bBench\b"
RELEASED_MODEL = r"\b[0-9]+(?:\.[0-9]+)?\s?[BM]\b|-(?:Instruct|Base|Chat|Distill)\b|\b(?:released|pre-?trained|open-?sourced?|distilled)\s+(?:[\w-]+\s+){0,2}(?:models?|checkpoints?|weights|LLMs?)\b"
FINDING_NOUNS = r"\b(?:studies|findings|observations)\b"
# Words too general to name a work, and nouns that make a family's name that of a group.
GENERAL_WORDS = "a an the on of for and in with to via towards toward is are all you need deep neural network networks learning model models graph graphs vision visual video image images language transformer transformers attention efficient fast faster scalable large scale new general improved improving training self supervised beyond simple survey review mixture experts expert sparse dense prediction segmentation detection classification recognition reinforcement flow flows diffusion generative".split()
GENERAL_NAMES = "ai ml nlp cv nn nns dnn cnn rnn gnn mlp lstm gru gpu tpu cpu sota llm moe api pca svm wl roi ieee acm".split()
STEM_FUNCTION_WORDS = "a an the in of for on with to from at by and as via into under without beyond towards toward".split()
GROUP_NOUNS = "works methods approaches models variants papers studies frameworks techniques".split()
