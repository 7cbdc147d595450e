from facetry.cli import main

main()
