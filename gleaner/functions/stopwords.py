"""Word lists."""

from __future__ import annotations

# Portuguese function words; "para" is left out on purpose.
PORTUGUESE = tuple(
    """a à ao aos aquela aquelas aquele aqueles aquilo as às até com como da das de dela delas dele deles depois do dos
    e é ela elas ele eles em entre era eram éramos essa essas esse esses esta está estamos estão estar estas estava
    estavam estávamos este esteja estejam estejamos estes esteve estive estivemos estiver estivera estiveram
    estivéramos estiverem estivermos estivesse estivessem estivéssemos estou eu foi fomos for fora foram fôramos forem
    formos fosse fossem fôssemos fui há haja hajam hajamos hão havemos haver hei houve houvemos houver houvera houverá
    houveram houvéramos houverão houverei houverem houveremos houveria houveriam houveríamos houvermos houvesse
    houvessem houvéssemos isso isto já lhe lhes mais mas me mesmo meu meus minha minhas muito na não nas nem no nos nós
    nossa nossas nosso nossos num numa o os ou pela pelas pelo pelos por qual quando que quem são se seja sejam sejamos
    sem ser será serão serei seremos seria seriam seríamos seu seus só somos sou sua suas também te tem tém temos tenha
    tenham tenhamos tenho terá terão terei teremos teria teriam teríamos teu teus teve tinha tinham tínhamos tive
    tivemos tiver tivera tiveram tivéramos tiverem tivermos tivesse tivessem tivéssemos tu tua tuas um uma você vocês
    vos""".split()
)
# Further words that topic models leave out, and words of the construction domain.
TOPIC_EXTRA = tuple("a e o as os um uma uns umas ao aos la so ha ja mas ou se".split())
DOMAIN = tuple(
    """para com em de do da dos das no na nos nas por ate sem sob sobre entre fornecimento instalacao execucao colocacao
    aplicacao assentamento fixacao montagem tipo simples duplo dupla normal padrao especial completo completa incluindo
    inclusive exceto equivalente equivalentes outros outras ou nao ate mais menos cada""".split()
)
