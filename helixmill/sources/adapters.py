"""Known adapters, for detection: single ones, and families of one adapter around the indexes of a kit."""

# Fixed values.
SINGLE = """
AGATCGGAAGAGCACACGTCTGAACTCCAGTCA
AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT
GATCGTCGGACTGTAGAACTCTGAACGTGTAGA
AATGATACGGCGACCACCGACAGGTTCAGAGTTCTACAGTCCGA
AATGATACGGCGACCACCGAGATCTACACGTTCAGAGTTCTACAGTCCGA
AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT
AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCTAGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTG
AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCTCAAGCAGAAGACGGCATACGAGCTCTTCCGATCT
ACACTCTTTCCCTACACGACGCTCTTCCGATCT
AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC
AGATCGGAAGAGCACACGTCTGAACTCCAGTCACATCACGATCTCGTATGCCGTCTTCTGCTTG
AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAG
AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTG
AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAGACCGATCTCGTATGCCGTCTTCTGCTTGAAA
AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTA
AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCTCGGTGGTCGCCGTATCATT
AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCTCGGTGGTCGCCGTATCATTAAAAAA
AGATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG
CAAGCAGAAGACGGCATACGAGATCGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT
CAAGCAGAAGACGGCATACGAGCTCTTCCGATCT
CCACTACGCCTCCGCTTTCCTCTCTATGGGCAGTCGGTGAT
CCGACAGGTTCAGAGTTCTACAGTCCGACATG
CGACAGGTTCAGAGTTCTACAGTCCGACGATC
CGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT
CTAATACGACTCACTATAGGGCAAGCAGTGGTATCAACGCAGAGT
CTGAGCGGGCTGGCAAGGCAGACCGATCTCGTATGCCGTCTTCTGCTTG
CTGATGGCGCGAGGGAGGCGTGTAGATCTCGGTGGTCGCCGTATCATT
CTGCCCCGGGTTCCTCATTCTCTCAGCAGCATG
CTGTCTCTTATACACATCTCCGAGCCCACGAGAC
CTGTCTCTTATACACATCTCTGAGCGGGCTGGCAAGGC
CTGTCTCTTATACACATCTCTGATGGCGCGAGGGAGGC
CTGTCTCTTATACACATCTGACGCTGCCGACGA
GATCGGAAGAGCACACGTCTGAACTCCAGTCAC
GATCGGAAGAGCGGTTCAGCAGGAATGCCGAG
GATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT
GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG
GTCTCGTGGGCTCGGAGATGTGTATAAGAGACAG
GTGACTGGAGTTCAGACGTGTGCTCTTCCGATCT
TACACTCTTTCCCTACACGACGCTCTTCCGATCT
TCGGACTGTAGAACTCTGAACGTGTAGATCTCGGTGGTCGCCGTATCATT
TCGTCGGCAGCGTCAGATGTGTATAAGAGACAG
TTTTTTTTTTAATGATACGGCGACCACCGAGATCTACAC
TTTTTTTTTTCAAGCAGAAGACGGCATACGA
AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA
AAGTCGGATCGTAGCCATGTCGTTCTGTGAGCCAAGGAGTTG
AACTGTAGGCACCATCAAT
""".split()

#: What stands before the index, what behind it, and the indexes.
FAMILIES = [
    ("CAAGCAGAAGACGGCATACGAGAT", "GTGACTGGAGTTC", "AAGCTA ACATCG ATTGGC CACTGT CGTGAT CTGATC GATCTG GCCTAA GTAGCC TACAAG TCAAGT TGGTCA"),
    ("CAAGCAGAAGACGGCATACGAGAT", "GTGACTGGAGTTCCTTGGCACCCGAGAATTCCA", "AAAATG AAGCTA ACATCG AGCTAG AGGAAT ATCAGT ATCGTG ATTATA ATTCCG ATTGGC CACTGT CCACTC CCGGTG CGAAAC CGATTA CGCCTG CGTACG CGTGAT CTCTAC CTGATC CTTCGA CTTTTG GAATGA GATCTG GCCATG GCCTAA GCGGAC GCTACC GCTCAT GCTGTA GGAACT GGACGG GGCCAC GTAGCC GTATAG GTCGTC TACAAG TAGTTG TCAAGT TCGGGA TCTGAG TGACAT TGAGTG TGCCGA TGGTCA TGTTGG TTGACT TTTCAC"),
    ("GATCGGAAGAGCACACGTCTGAACTCCAGTCAC", "ATCTCGTATGCCGTCTTCTGCTTG", "ACAGTG ACTGATAT ACTGAT ACTTGA AGTCAACA AGTTCCGT ATCACG ATGTCAGA ATTCCTTT CAGATC CCGTCCCG CGATGT CGTACGTA CTTGTA GAGTGGAT GATCAG GCCAAT GGCTAC GTCCGCAC GTCCGC GTGAAACG GTGGCCTT GTTTCGGA TAGCTT TGACCA TTAGGC"),
    ("GATCGGAAGAGCACACGTCTGAACTCCAGTCAC", "CTCGTATGCCGTCTTCTGCTTG", "AGTCAACT AGTTCCGT ATGTCAGT ATTCCTTT CCACTCTT CCGTCCCT CGTACGTT GTGAAACT GTGGCCTT GTTTCGGT"),
    ("TGGAATTCTCGGGTGCCAAGGAACTCCAGTCAC", "ATCTCGTATGCCGTCTTCTGCTTG", "ACAGTG ACTGAT ACTTGA AGTCAA AGTTCC ATCACG ATGAGC ATGTCA ATTCCT CAAAAG CAACTA CACCGG CACGAT CACTCA CAGATC CAGGCG CATGGC CATTTT CCAACA CCGTCC CGATGT CGGAAT CGTACG CTAGCT CTATAC CTCAGA CTTGTA GACGAC GAGTGG GATCAG GCCAAT GGCTAC GGTAGC GTAGAG GTCCGC GTGAAA GTGGCC GTTTCG TAATCG TACAGC TAGCTT TATAAT TCATTC TCCCGA TCGAAG TCGGCA TGACCA TTAGGC"),
    ("CCGAGCCCACGAGAC", "ATCTCGTATGCCGTCTTCTGCTTG", "AAGAGGCA ACTCGCTA ACTGAGCG AGGCAGAA ATCTCAGG ATGCGCAG CAGAGAGG CCTAAGAC CGAGGCTG CGATCAGT CGGAGCCT CGTACTAG CTCTCTAC GCGTAGTA GCTACGCT GCTCATGA GGACTCCT GGAGCTAC GTAGAGGA TAAGGCGA TACGCTGC TAGCGCTC TAGGCATG TCCTGAGC TCGACGTC TGCAGCTA"),
    ("GACGCTGCCGACGA", "GTGTAGATCTCGGTGGTCGCCGTATCATT", "ACTCTAGG AGAGGATA AGCTAGAA AGGCTTAG ATAGAGAG ATAGCCTT ATTAGACG CGGAGAGA CTAGTCGA CTCCTTAC CTTAATAG GCGATCTA TAAGGCTC TACTCCTT TATGCAGT TCGCATAA TCTACTCT TCTTACGC"),
]

KNOWN = sorted({*SINGLE, *(before + index + behind for before, behind, indexes in FAMILIES for index in indexes.split())})
